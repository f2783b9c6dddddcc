"""Text functions in built-in expressions: keys, cleaning, tokens, tags, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_key(c: str | Column) -> Column:
    """The text without brackets, queries and dashes, in lower case, white space collapsed: equal keys are one text.

    (Texts with letters that fold to several, such as ß, need :func:`stelae.functions.normalize.folded` first.)
    """
    # only white space that is not one blank is rewritten: most of it is
    return F.trim(F.regexp_replace(F.translate(F.lower(_c(c)), "[]<>{}()?–—-", ""), r"\s{2,}|[^\S ]", " "))


def tokens(c: str | Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(_c(c), r"\s+"), lambda x: x != "")


#: Look-alike characters of scans, and what each stands for.
LOOKALIKES = (
    "Э e, И n, Я r, О o, А a, Т t, Е e, Ч kh, З z, Ј i, Ѵ v, Ǝ e, ǝ e, Ɔ c, Ƨ s, Ʀ r, Ɐ a, Ɯ m, Ɛ e, Ↄ c, ↄ c, ⅃ l, ∃ e, ∂ , "
    "ê e, þ θ, Þ Θ, ð , Ð , ° , Æ ae, Ç c, Å a, υ u, ϑ θ, ț t"
)


def unscanned(c: str | Column) -> Column:
    """Look-alikes replaced in one pass; those that stand for two letters are replaced after the single ones, which never yield them."""
    pairs = [p.split(" ") for p in LOOKALIKES.split(", ")]
    single = [(a, b) for a, b in pairs if len(b) == 1] + [(a, b) for a, b in pairs if b == ""]
    out = F.translate(_c(c), "".join(a for a, _ in single), "".join(b for _, b in single))
    for a, b in pairs:
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def characters(c: str | Column) -> Column:
    return F.filter(F.split(_c(c), ""), lambda x: x != "")


def residual_characters(c: str | Column, allowed: str) -> Column:
    """Distinct characters outside ``allowed``, in order."""
    return F.array_sort(F.array_except(F.array_distinct(characters(c)), F.array(*[F.lit(x) for x in allowed])))


def scan_quality(original: Column, residual: Column) -> Column:
    """Digits or plus signs in the original: the scan failed; characters left over: review; else clean."""
    return F.when(original.rlike(r"[0-9+]"), "ocr_failed").when(F.size(residual) > 0, "needs_review").otherwise("clean")


#: Characters that part words, and marks of editors within words.
WORD_BREAKS, EDITOR_MARKS = r"[\s·•|:;]+", r"[\[\]()<>{}?…⸢⸣-]"


def intact_tokens(c: str | Column) -> Column:
    """Tokens without editors' marks or hyphens, as struct (text, ratio); no tokens: '' and 0."""
    every = F.filter(F.split(_c(c), WORD_BREAKS), lambda x: x != "")
    whole = F.filter(every, lambda x: ~x.rlike(EDITOR_MARKS))
    return F.struct(
        F.array_join(whole, " ").alias("text"), F.when(F.size(every) > 0, F.size(whole) / F.size(every)).otherwise(0.0).alias("ratio")
    )


def latin_spelling(c: str | Column) -> Column:
    """A word in capitals that is no Roman numeral, or of four letters or more and three quarters capitals, or capitalised and of four letters or more."""
    found = F.regexp_extract_all(_c(c), F.lit("[A-Za-z]+"), F.lit(0))

    def latin(w: Column) -> Column:
        capitals = F.length(F.regexp_replace(w, "[^A-Z]", ""))
        all_caps = (F.length(w) >= 2) & (capitals == F.length(w)) & ~w.rlike("^[IVXLCDM]+$")
        mostly = (F.length(w) >= 4) & (capitals >= 0.75 * F.length(w)) & ~w.rlike("^[IVXLCDM]+$")
        title = (F.length(w) >= 4) & w.rlike("^[A-Z][a-z]+$")
        return all_caps | mostly | title

    return F.exists(found, latin)


def language_hint(c: str | Column, keywords: list[str]) -> Column:
    """Letters that the script lacks: likely Latin; a keyword: confident; else a candidate; blank: unknown."""
    t = F.lower(_c(c))
    return (
        F.when(F.trim(F.coalesce(t, F.lit(""))) == "", "unknown")
        .when(t.rlike("[bdgo]"), "likely_latin")
        .when(F.arrays_overlap(F.split(t, r"[^\p{L}]+"), F.array(*[F.lit(k) for k in keywords])), "confident")
        .otherwise("candidate")
    )


def source_tag(c: str | Column) -> Column:
    """By the form of an identifier: ``CIE n``, ``ETP n``, two letters and a digit, or another."""
    t = _c(c)
    return F.when(t.startswith("CIE "), "cie").when(t.startswith("ETP "), "etp").when(t.rlike("^[A-Z][a-z] [0-9]"), "et").otherwise("other")


def sieve(c: str | Column, letters: str, words: list[str], endings: list[str], rescued: list[str]) -> Column:
    """Foreign by letter, word or ending, unless a rescue word is present."""
    t = F.lower(_c(c))
    whole = lambda ws: rf"(^|[^\p{{L}}])({'|'.join(ws)})([^\p{{L}}]|$)"
    hit = t.rlike(f"[{letters}]") | t.rlike(whole(words)) | t.rlike(rf"[a-z]({'|'.join(endings)})([^\p{{L}}]|$)")
    return hit & ~t.rlike(whole(rescued))


def expand_ids(df: DataFrame, col: str, out: str = "id") -> DataFrame:
    """One row per identifier: ``a et b``, ``a-b`` and ``a, b, c`` list several; others stay as they are."""
    c = F.trim(F.col(col))
    span = F.sequence(F.regexp_extract(c, "^([0-9]+)", 1).cast("int"), F.regexp_extract(c, "-([0-9]+)$", 1).cast("int"))
    listed = F.filter(F.split(c, r"\s*,\s*|\s+et\s+"), lambda x: x != "")
    many = F.when(c.rlike("^[0-9]+-[0-9]+$"), F.transform(span, lambda i: i.cast("string"))).otherwise(listed)
    return df.withColumn(out, F.explode(many))


def lacunae(c: str | Column, least: int = 1) -> Column:
    """The only restored span of a text, struct (restoration, width, bucket), or null: the text must hold exactly one usable
    bracket, of letters and blanks without dots, dashes or queries, and not be the bracket alone. Blanks do not count to the width."""
    found = F.regexp_extract_all(_c(c), F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    usable = F.filter(found, lambda x: ~x.rlike(r"[.…?\-]") & (F.trim(x) != ""))
    one = F.element_at(usable, 1)
    width = F.length(F.regexp_replace(one, r"[\s.]", ""))
    outside = F.trim(F.regexp_replace(_c(c), r"\[[^\[\]]*\]", "")) != ""
    bucket = F.when(width == 1, "w1").when(width <= 3, "w2_3").when(width <= 6, "w4_6").otherwise("w7_plus")
    ok = (F.size(usable) == 1) & (F.size(found) == 1) & outside & (width >= least)
    return F.when(ok, F.struct(one.alias("restoration"), width.alias("width"), bucket.alias("bucket")))


def gap_width(c: str | Column) -> Column:
    """Dots and dashes of a gap; null where an ellipsis leaves it open."""
    return F.when(_c(c).contains("…"), F.lit(None)).otherwise(F.length(F.regexp_replace(_c(c), r"[^.\-]", "")))


def masked(prefix: Column, width: Column, suffix: Column) -> Column:
    return F.concat(prefix, F.repeat(F.lit("?"), width), suffix)


def hallucinated(prefix: Column, suffix: Column, width: Column, restored: Column) -> Column:
    """Any change outside the masked span, or a text too short or empty to hold it."""
    n = F.length(prefix) + width + F.length(suffix)
    kept = (F.substring(restored, F.lit(1), F.length(prefix)) == prefix) & (F.substring(restored, F.length(prefix) + width + 1, F.length(restored)) == suffix)
    return F.coalesce(F.length(restored) < n, F.lit(True)) | ~kept


def stem(c: str | Column, endings: list[str], least: int = 3) -> Column:
    """Without the longest listed ending that leaves ``least`` letters."""
    longest = "|".join(sorted(endings, key=len, reverse=True))
    return F.regexp_replace(_c(c), rf"^(.{{{least},}}?)({longest})$", "$1")


def char_ngrams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def date_display(year: Column, uncertainty: Column) -> Column:
    """``500 ± 25 BCE``; year 0 counts as CE, an uncertainty of 0 is not shown."""
    era = F.when(year < 0, "BCE").otherwise("CE")
    plus = F.when(F.coalesce(uncertainty, F.lit(0)) > 0, F.concat(F.lit(" ± "), uncertainty.cast("string"))).otherwise("")
    return F.when(year.isNull(), "undated").otherwise(F.concat(F.abs(year).cast("string"), plus, F.lit(" "), era))


def midpoint(first: Column, last: Column) -> tuple[Column, Column]:
    """(midpoint, half-width) of a range of years, both rounded down."""
    return F.floor((first + last) / 2).cast("int"), F.floor(F.abs(last - first) / 2).cast("int")


def context_text(parts: dict[str, Column], limits: dict[str, int]) -> Column:
    """``key: value | ...`` of the values present, each cut to its limit."""
    made = [F.when(F.trim(v) != "", F.concat(F.lit(f"{k}: "), F.substring(v, 1, limits[k]) if k in limits else v)) for k, v in parts.items()]
    return F.concat_ws(" | ", *made)


def gloss_problem(word: Column, gloss: Column, lang: Column, quote: Column, passage: Column, languages: list[str]) -> Column:
    """Why a gloss is no evidence, or null: fields present, a known language, and the quote verbatim in the passage."""
    blank = [F.trim(F.coalesce(x, F.lit(""))) == "" for x in (word, gloss, lang, quote)]
    return (
        F.when(blank[0] | blank[1] | blank[2] | blank[3], "missing_field")
        .when(~lang.isin(languages), "unknown_language")
        .when(~F.contains(passage, quote), "quote_not_in_passage")
    )


def iso_timestamp(c: Column) -> Column:
    """A timestamp in ISO 8601, in UTC with seconds; null stays null."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
