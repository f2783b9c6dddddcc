"""Flags, reasons and routes of records; ordered patterns; evidence from passages; windows around keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stelae.functions.text import char_ngrams, characters


def first_pattern(df: DataFrame, text: str, patterns: DataFrame, pattern: str, order: str, values: list[str]) -> DataFrame:
    """``df`` with the values of the first pattern (in ``order``) that its text contains, else null. ``patterns`` is a stated list of
    at most 1,000 rows; it is read once on the driver and becomes one expression, so nothing is joined."""
    rows = patterns.select(pattern, order, *values).orderBy(order).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 patterns")
    low, out = F.lower(F.col(text)), df
    for v in values:
        kind = patterns.schema[v].dataType
        c = F.lit(None).cast(kind)
        for r in reversed(rows):
            c = F.when(low.contains(r[pattern].lower()), F.lit(r[v]).cast(kind)).otherwise(c)
        out = out.withColumn(v, c)
    return out


def auto_flags(text: Column, lat: Column, lon: Column, alphabet: str, box: tuple[float, float, float, float] = (35, 48, 5, 18), duplicate: Column | None = None) -> Column:
    """What is odd about a record, as an array: letters outside the alphabet, coordinates out of the box, near-duplicates."""
    odd = F.array_sort(F.array_except(F.array_distinct(characters(F.lower(text))), F.array(*[F.lit(c) for c in alphabet])))
    s, n, w, e = box
    return F.array_compact(
        F.array(
            F.when(F.size(odd) > 0, F.concat(F.lit("non_alphabet_chars: "), F.array_join(odd, " "))),
            F.when(~lat.between(s, n), "lat_out_of_range"),
            F.when(~lon.between(w, e), "lon_out_of_range"),
            F.when(duplicate, "near_duplicate") if duplicate is not None else F.lit(None).cast("string"),
        )
    )


#: What stands for no place.
PLACEHOLDERS = ("n/a", "unknown", "none", "-", "?", "incerta", "ignota", "")


def place_route(place: Column) -> Column:
    """``placeholder``, ``missing`` or ``named``: filter on it to write each part."""
    return F.when(place.isNull(), "missing").when(F.lower(F.trim(place)).isin(*PLACEHOLDERS), "placeholder").otherwise("named")


def markers_found(text: Column, markers: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))


def rescue(text: Column, genitives: list[str], vetoes: list[str]) -> Column:
    """Rows with a rescue ending and no word that forbids it."""
    low = F.lower(text)
    return low.rlike(rf"[a-zθφχśξ]({'|'.join(genitives)})([^\p{{L}}]|$)") & ~low.rlike(rf"(^|[^\p{{L}}])({'|'.join(vetoes)})([^\p{{L}}]|$)")


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A value by key, else the ``*`` entry, else the default."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.try_element_at(m, F.lit("*")), F.lit(default))


def uri(key: Column, prefix: str) -> Column:
    """Null and blank keys have none."""
    return F.when(F.trim(key) != "", F.concat(F.lit(prefix), F.trim(key)))


def loose_token(c: Column) -> Column:
    """Without marks on letters (taken off before), final sigma as sigma, without one last m or s."""
    return F.regexp_replace(F.translate(F.lower(c), "ς", "σ"), r"(?<=..)[ms]$", "")


def glosses(df: DataFrame, text: str, patterns: dict[str, str], keep: list[str]) -> DataFrame:
    """(keep..., pattern, word): the first group of every match of each named pattern."""
    found = [_named(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)), name) for name, p in patterns.items()]
    return df.select(*keep, F.explode(F.flatten(F.array(*found))).alias("x")).select(*keep, "x.pattern", "x.word")


def _named(words: Column, name: str) -> Column:
    return F.transform(words, lambda w: F.struct(F.lit(name).alias("pattern"), w.alias("word")))


def keyword_windows(text: Column, keyword: str, context: int) -> Column:
    """Merged stretches of ``context`` characters around each keyword, joined by ``[...]``; without one, head and tail."""
    import re

    n = len(keyword)
    parts = F.split(F.lower(text), "(?=" + re.escape(keyword.lower()) + ")")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    hits = F.aggregate(
        parts,
        start,
        lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.when((a["at"] > 0) | F.lower(text).startswith(keyword.lower()), F.concat(a["hits"], F.array(a["at"]))).otherwise(a["hits"]).alias("hits")),
        lambda a: a["hits"],
    )
    spans = F.transform(hits, lambda h: F.struct(F.greatest(h - context, F.lit(0)).alias("s"), F.least(h + n + context, F.length(text)).alias("e")))

    def merge(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(F.size(a) == 0, F.array(x)).when(x["s"] <= last["e"], joined).otherwise(F.concat(a, F.array(x)))

    none = F.array().cast("array<struct<s:int,e:int>>")
    merged = F.aggregate(spans, none, merge)
    cut = F.array_join(F.transform(merged, lambda w: F.substring(text, w["s"] + 1, w["e"] - w["s"])), " [...] ")
    ends = F.when(F.length(text) <= 2 * context, text).otherwise(F.concat(F.substring(text, 1, context), F.lit(" [...] "), F.substring(text, -context, context)))
    return F.when(F.size(hits) > 0, cut).otherwise(ends)


def unfenced_json(c: Column, schema: str) -> Column:
    """A model's answer as a struct array: code fences off, a list or an envelope with one, else null."""
    bare = F.trim(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    whole = F.from_json(bare, f"array<struct<{schema}>>")
    inner = F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), f"array<struct<{schema}>>")
    return F.when(bare.startswith("["), whole).otherwise(inner)


def masked_samples(df: DataFrame, id_col: str, text: str, per_text: int, seed: int = 42) -> DataFrame:
    """(id, position, masked, gold): letters hidden one at a time, the ``per_text`` first in hash order of their places."""
    t = F.col(text)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.substring(t, i, F.lit(1)).rlike(r"\p{L}"))
    ranked = F.array_sort(F.transform(at, lambda i: F.struct(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), i.cast("string"), F.lit(str(seed))).cast("binary")).alias("h"), i.alias("i"))))
    rows = df.select(id_col, t.alias("t"), F.explode(F.slice(ranked, 1, per_text)).alias("x"))
    i = F.col("x.i")
    return rows.select(id_col, i.alias("position"), F.concat(F.substring("t", F.lit(1), i - 1), F.lit("?"), F.substring("t", i + 1, F.length("t"))).alias("masked"), F.substring("t", i, F.lit(1)).alias("gold"))


def parallels(df: DataFrame, id_col: str, text: str, queries: DataFrame, k: int, n: int = 3) -> DataFrame:
    """(query, id, cosine): texts like each query by counts of character n-grams, the ``k`` best, without itself, texts that hold
    it or that it holds, and copies (cosine over 0.9 and lengths within 2)."""
    from .search import first_per

    def counted(d: DataFrame, name: str) -> DataFrame:
        g = d.select(F.col(id_col).alias(name), F.explode(char_ngrams(F.lower(F.col(text)), n)).alias("g")).groupBy(name, "g").agg(F.count("*").alias("c"))
        length = g.groupBy(name).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("l"))
        return g.join(length, name).select(name, "g", (F.col("c") / F.col("l")).alias(f"w_{name}"))

    met = counted(queries, "query").join(counted(df, "other"), "g").groupBy("query", "other").agg(F.sum(F.col("w_query") * F.col("w_other")).alias("cosine"))
    a = queries.select(F.col(id_col).alias("query"), F.col(text).alias("_a"))
    b = df.select(F.col(id_col).alias("other"), F.col(text).alias("_b"))
    rows = met.where("query <> other").join(a, "query").join(b, "other")
    rows = rows.where(~F.contains("_a", "_b") & ~F.contains("_b", "_a") & ~((F.col("cosine") > 0.9) & (F.abs(F.length("_a") - F.length("_b")) <= 2)))
    return first_per(rows.select("query", "other", "cosine"), ["query"], [F.desc("cosine"), F.col("other")], k)


def encoded_characters(text: Column, vocabulary: str, length: int, unknown: int = 1, pad: int = 0) -> Column:
    """Numbers of characters (from 2, in the vocabulary's order), padded or cut to ``length``."""
    known = F.array(*[F.lit(c) for c in vocabulary])
    ids = F.transform(characters(text), lambda c: F.coalesce(F.nullif(F.array_position(known, c), F.lit(0)).cast("int") + 1, F.lit(unknown)))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def tags_by_file(df: DataFrame, file: str, order: str, tags: str) -> DataFrame:
    """(file, tags): each tag once, in order of first place."""
    e = df.select(file, order, F.posexplode(tags).alias("p", "tag")).groupBy(file, "tag").agg(F.min(F.struct(order, "p")).alias("o"))
    return e.groupBy(file).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "tag"))), lambda x: x["tag"]).alias("tags"))


def review(decisions: DataFrame, proposals: DataFrame, key: str, value: str) -> DataFrame:
    """Proposals after review: skipped ones go, edits replace the value, those without a decision wait."""
    d = decisions.select(key, "decision", F.col("override").alias("_o"))
    out = proposals.join(d, key, "left").where(F.coalesce(F.col("decision"), F.lit("")) != "skip")
    return out.withColumn(value, F.when(F.col("decision") == "edit", F.col("_o")).otherwise(F.col(value))).withColumn("state", F.when(F.col("decision").isNull(), "waiting").otherwise("kept")).drop("_o", "decision")
