"""Letter frequencies, contingency, dating by tags and by Bayes, keyword labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def letter_frequencies(df: DataFrame, by: str, text_col: str, alphabet: str) -> DataFrame:
    """(by, letter, n, share) for every letter of the alphabet, those that do not occur with 0; shares are of the group's letters."""
    letters = list(dict.fromkeys(alphabet))
    low = F.lower(F.coalesce(text_col, F.lit("")))
    # how much shorter a text is without a letter: no character becomes a row, and sums are partial on each task
    sums = [F.sum(F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(c)))).cast("bigint") for c in letters]
    wide = df.select(by, low.alias("_t")).groupBy(by).agg(F.array(*sums).alias("_n"))
    total = F.aggregate("_n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = wide.select(by, total.alias("_all"), F.posexplode("_n").alias("_i", "n"))
    name = F.element_at(F.array(*[F.lit(c) for c in letters]), F.col("_i") + 1)
    return out.select(by, name.alias("letter"), "n", F.when(F.col("_all") > 0, F.col("n") / F.col("_all")).otherwise(0.0).alias("share"))


def chi_squared(counts: DataFrame, row: str, col: str, n: str) -> DataFrame:
    """One row (chi2, dof, total, cramers_v, p_value, significant) of a contingency table in long form; rows and columns that sum
    to 0 fall out; Yates' correction at one degree of freedom; significant below 0.05. Without a degree of freedom chi2 says
    nothing: p_value 1."""
    live = counts.where(F.col(n) > 0)
    rows, cols = live.groupBy(row).agg(F.sum(n).alias("_r")), live.groupBy(col).agg(F.sum(n).alias("_c"))
    all_ = live.agg(F.sum(n).alias("_t"), F.count_distinct(row).alias("_nr"), F.count_distinct(col).alias("_nc"))
    cells = rows.crossJoin(F.broadcast(cols)).join(live.select(row, col, F.col(n).alias("_o")), [row, col], "left").crossJoin(F.broadcast(all_))
    expected = F.col("_r") * F.col("_c") / F.col("_t")
    dof = (F.col("_nr") - 1) * (F.col("_nc") - 1)
    gap = F.abs(F.coalesce("_o", F.lit(0)) - expected)
    gap = F.when(dof == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = cells.select((gap * gap / expected).alias("x"), dof.alias("dof"), "_t", F.least("_nr", "_nc").alias("k"))
    made = out.agg(F.sum("x").alias("chi2"), F.max("dof").alias("dof"), F.max("_t").alias("total"), F.max("k").alias("k"))
    out = made.select("chi2", "dof", "total", F.sqrt(F.col("chi2") / (F.col("total") * (F.col("k") - 1))).alias("cramers_v"))
    return out.withColumn("p_value", chi_square_tail(F.col("chi2"), F.col("dof"))).withColumn("significant", F.col("p_value") < 0.05)


def chi_square_tail(x: Column, dof: Column) -> Column:
    """Of a chi-square variable with a whole number of degrees of freedom, the chance to exceed ``x``: 1 minus the series of the
    lower incomplete gamma function, with the gamma function as a product down from ``dof`` / 2."""
    a, z = dof / 2, x / 2
    step = lambda s, i: F.struct((s["t"] * z / (a + i)).alias("t"), (s["sum"] + s["t"] * z / (a + i)).alias("sum"))
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100) + F.ceil(z * 2).cast("int")), zero, step, lambda s: s["sum"])
    log_gamma = F.aggregate(F.sequence(F.lit(0), F.ceil(a).cast("int") - 1), F.lit(0.0), lambda s, i: s + F.ln(a - i)) + F.when(dof % 2 == 1, math.log(math.pi) / 2).otherwise(0.0)
    below = F.exp(a * F.ln(z) - z - log_gamma) * series
    return F.when((dof <= 0) | (x <= 0), 1.0).when(z > 700, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - below))


def softmax(scores: Column) -> Column:
    """An array of scores as shares that sum to 1."""
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda t, v: t + v))


def dating_features(canonical: Column) -> dict[str, Column]:
    """Spellings that date a text."""
    has = lambda s: canonical.contains(s)
    kinds = sum((F.when(has(s), 1).otherwise(0) for s in ("s", "ś", "ξ", "z")), F.lit(0))
    return {
        "k_before_a": has("ka"),
        "q_present": has("q"),
        "no_f": ~has("f"),
        "three_sibilants": kinds >= 2,
        "c_dominant": has("c") & ~has("k") & ~has("q"),
        "aspirates_frequent": canonical.rlike("[θφχ]"),
        "genitive_al": canonical.rlike(r"al(\s|$)"),
        "f_present": has("f"),
        "simplified_sibilants": has("s") & ~has("ś") & ~has("ξ"),
        "latin_influence": canonical.rlike("[dbgo]"),
    }


#: How much each spelling speaks for its period.
TAG_WEIGHTS = {
    "archaic": {"k_before_a": 0.35, "q_present": 0.30, "no_f": 0.20, "three_sibilants": 0.15},
    "classical": {"c_dominant": 0.40, "aspirates_frequent": 0.30, "genitive_al": 0.30},
    "late": {"f_present": 0.40, "simplified_sibilants": 0.30, "latin_influence": 0.30},
}
#: The chance of each spelling in 13 bins of 50 years from 700 BCE on.
FIRST_BIN, BIN_YEARS = -700, 50
LIKELIHOODS = {
    "k_before_a": [0.90, 0.85, 0.80, 0.70, 0.15, 0.08, 0.03, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01],
    "q_present": [0.80, 0.75, 0.70, 0.60, 0.15, 0.08, 0.03, 0.02, 0.01, 0.01, 0.01, 0.01, 0.01],
    "no_f": [0.98, 0.97, 0.95, 0.90, 0.70, 0.40, 0.20, 0.10, 0.05, 0.03, 0.02, 0.02, 0.01],
    "three_sibilants": [0.85, 0.80, 0.75, 0.65, 0.45, 0.30, 0.20, 0.15, 0.10, 0.08, 0.05, 0.05, 0.03],
    "c_dominant": [0.05, 0.08, 0.15, 0.30, 0.70, 0.80, 0.85, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60],
    "aspirates_frequent": [0.30, 0.35, 0.45, 0.55, 0.70, 0.75, 0.80, 0.75, 0.60, 0.50, 0.45, 0.40, 0.35],
    "genitive_al": [0.10, 0.15, 0.25, 0.40, 0.60, 0.70, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50, 0.45],
    "f_present": [0.02, 0.03, 0.05, 0.10, 0.30, 0.60, 0.80, 0.90, 0.95, 0.97, 0.98, 0.98, 0.99],
    "simplified_sibilants": [0.05, 0.08, 0.10, 0.15, 0.25, 0.40, 0.55, 0.70, 0.80, 0.85, 0.90, 0.92, 0.95],
    "latin_influence": [0.01, 0.01, 0.01, 0.02, 0.03, 0.05, 0.10, 0.15, 0.25, 0.40, 0.55, 0.70, 0.80],
}


def dating_tags(df: DataFrame, id_col: str, canonical: Column, least: float = 0.20, gap: float = 0.10) -> DataFrame:
    """(id, archaic, classical, late, period): weight of the spellings found for each period; no clear best: indeterminate."""
    f = dating_features(canonical)
    blank = F.trim(canonical) == ""
    scores = {p: F.when(blank, 0.0).otherwise(sum((F.when(f[k], w).otherwise(0.0) for k, w in ws.items()), F.lit(0.0))) for p, ws in TAG_WEIGHTS.items()}
    out = df.select(id_col, *[F.round(s, 4).alias(p) for p, s in scores.items()])
    ranked = F.array_sort(F.array(*scores), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    best = F.when(F.col("archaic") == ranked[0], "archaic").when(F.col("classical") == ranked[0], "classical").otherwise("late")
    return out.withColumn("period", F.when((ranked[0] < least) | (F.round(ranked[0] - ranked[1], 4) < gap), "indeterminate").otherwise(best))


def dating_posterior(df: DataFrame, id_col: str, canonical: Column) -> DataFrame:
    """(id, bin, year, p): posterior over bins of years under a uniform prior; ``year`` is the bin's middle.

    The log-likelihood of a bin is a sum of constants picked by the features, so it is one expression without a join.
    """
    seen = df.select(id_col, *[F.coalesce(c, F.lit(False)).alias(f"f_{k}") for k, c in dating_features(canonical).items()])
    f = {k: F.col(f"f_{k}") for k in LIKELIHOODS}
    bins = range(len(next(iter(LIKELIHOODS.values()))))
    floor = lambda p: F.ln(F.lit(max(p, 1e-10)))
    sums = [sum((F.when(f[k], floor(p[b])).otherwise(floor(1 - p[b])) for k, p in LIKELIHOODS.items()), F.lit(0.0)) for b in bins]
    # each array of one array binds its element to a name, so that no step is computed again for every bin
    weights = F.transform(F.array(F.array(*sums)), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
    shares = F.transform(weights, lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, y: a + y)))
    out = seen.select(id_col, F.posexplode(shares[0]).alias("bin", "p"))
    return out.select(id_col, "bin", (FIRST_BIN + BIN_YEARS * F.col("bin") + BIN_YEARS // 2).alias("year"), "p")


def credible_interval(posterior: DataFrame, id_col: str, share: float = 0.95) -> DataFrame:
    """(id, map_year, low, high): the middle of the likeliest bin, and the hull of the likeliest bins that make up ``share``."""
    w = Window.partitionBy(id_col).orderBy(F.desc("p"), "bin")
    ranked = posterior.withColumn("before", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("p"))
    kept = ranked.where(F.col("before") < share)
    half = BIN_YEARS // 2
    return kept.groupBy(id_col).agg(
        F.max_by("year", F.struct("p", -F.col("bin"))).alias("map_year"), (F.min("year") - half).alias("low"), (F.max("year") + half).alias("high")
    )


def keyword_labels(df: DataFrame, id_col: str, text: Column, vocabulary: dict[str, list[str]]) -> DataFrame:
    """(id, label, score): a keyword that is a token counts 1, one that is only within the text 0.5; over the category's size.
    The first best category wins; no hit: unknown."""
    low = F.lower(text)
    toks = F.split(low, r"[^\p{L}]+")
    scores = {}
    for k, ws in vocabulary.items():
        hits = sum((F.when(F.array_contains(toks, w), 1.0).when(low.contains(w), 0.5).otherwise(0.0) for w in ws), F.lit(0.0))
        scores[k] = hits / len(ws)
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    label = F.lit("unknown")
    for k in reversed(list(scores)):
        label = F.when((scores[k] == best) & (best > 0), k).otherwise(label)
    return df.select(id_col, label.alias("label"), best.alias("score"))


def tiered_labels(df: DataFrame, id_col: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(id, label, rule): the first rule (label, name, condition) that holds; none: null, an abstention."""
    out = F.lit(None).cast("struct<label:string,rule:string>")
    for label, name, cond in reversed(rules):
        out = F.when(cond, F.struct(F.lit(label).alias("label"), F.lit(name).alias("rule"))).otherwise(out)
    return df.select(id_col, out.alias("r")).select(id_col, "r.label", "r.rule")
