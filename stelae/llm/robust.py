"""Quality rules and robust multivariate outliers.

Counts of every text feed two verdicts: fixed limits, and the Mahalanobis distance of a transformed vector of
statistics from a minimum-covariance-determinant estimate of its language and source. The estimate is the
deterministic variant: start from medians and spreads, then concentration steps, each of which fits mean and
covariance on the share ``keep`` of rows that are nearest by the estimate before, and corrects for the share left
out. Each step is two aggregations with map-side partial sums over all rows: a histogram of distances for each group
(so the cut is a bin's edge, the same at any partitioning), then first and second moments within the cut. Groups
below ``least`` rows use the estimate of their language, and those languages that of the whole table.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_texts, stage, unstage

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ("x0", "x1", "x2", "x3", "x4")
#: Least spread of each transformed statistic, so that groups without any spread judge no finer difference; each is small enough that its
#: statistic alone can pass the cut (the last: a fifth of the words repeated).
FLOOR = (0.5, 0.08, 0.05, 0.15, 0.079)
KEEP, STEPS, LEAST, SHARE = 0.75, 4, 200, 0.99999
BINS, PER_UNIT = 400, 8
WINDOW = 5


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Bytes are split at ASCII white space only."""
    words = text.split()
    n = len(words)
    flat = np.frombuffer(text, np.uint8)
    starts = int(((flat & 0xC0) != 0x80).sum())
    blanks = int(((flat == 32) | ((flat >= 9) & (flat <= 13))).sum())
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n >= WINDOW:
        grams = list(zip(*(words[i:] for i in range(WINDOW))))
        first: dict[tuple, int] = {}
        again = [i for i, g in enumerate(grams) if first.setdefault(g, i) != i]
        if again:
            marked = np.zeros(n + 1, np.int64)
            at = np.array(again + [first[grams[i]] for i in again])
            np.add.at(marked, at, 1)
            np.add.at(marked, np.minimum(at + WINDOW, n), -1)
            repeated = int((np.cumsum(marked)[:n] > 0).sum())
    return n, starts - blanks, symbols, len(lines) - len(set(lines)), repeated


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the five counts, n_lines) for every row; null texts count as empty."""

    def rows(ids, texts):
        made = [counts(t) for t in texts]
        out = {"doc_id": ids, "n_lines": [t.count(b"\n") + 1 for t in texts]}
        for k, name in enumerate(COUNTS):
            out[name] = [m[k] for m in made]
        return out

    schema = f"doc_id {id_type(docs, id_col).simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, n_lines bigint"
    return map_texts(docs, rows, schema, id_col, text_col)


def transformed() -> list[Column]:
    """Of the counts: logs of words and of word length, and square roots of shares, which even out their spread."""
    n = F.greatest("n_words", F.lit(1))
    return [
        F.log1p("n_words").alias("x0"),
        F.log(F.greatest(F.col("word_chars") / n, F.lit(0.5))).alias("x1"),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("x2"),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("x3"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x4"),
    ]


def chi_square_quantile(share: float, dof: int) -> float:
    """By bisection on the regularised lower incomplete gamma series."""

    def below(x: float) -> float:
        a, x = dof / 2, x / 2
        term = total = 1 / a
        for k in range(1, 500):
            term *= x / (a + k)
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    lo, hi = 1e-9, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < share else (lo, mid)
    return (lo + hi) / 2


def consistency(keep: float, dof: int) -> float:
    """By how much the covariance of the nearest share ``keep`` of normal rows falls short."""
    q = chi_square_quantile(keep, dof)
    a, x = (dof + 2) / 2, q / 2
    term = total = 1 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return keep / (total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def _distance() -> Column:
    """Squared, by the inverse covariance in column ``inv`` (row by row) around ``mu``."""
    p = len(STATS)
    d = [F.col(s) - F.col("mu")[k] for k, s in enumerate(STATS)]
    terms = [F.col("inv")[i * p + j] * d[i] * d[j] * (1 if i == j else 2) for i, j in combinations_with_replacement(range(p), 2)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.greatest(out, F.lit(0.0))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    pairs = list(combinations_with_replacement(range(len(STATS)), 2))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(s) for s in STATS]).alias("sums"),
        F.array(*[F.sum(F.col(STATS[i]) * F.col(STATS[j])) for i, j in pairs]).alias("products"),
    )


def _estimates(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """(keys, mu, inv): one small matrix inversion for each group, where the group is."""
    p = len(STATS)
    floor = np.array(FLOOR) ** 2

    def invert(frames):
        for f in frames:
            mu, inv = [], []
            for n, sums, products in zip(f["n"], f["sums"], f["products"]):
                m = np.asarray(sums, float) / max(n, 1)
                c = np.zeros((p, p))
                for (i, j), v in zip(combinations_with_replacement(range(p), 2), products):
                    c[i, j] = c[j, i] = v / max(n, 1) - m[i] * m[j]
                c *= factor
                c[np.diag_indices(p)] = np.maximum(np.diag(c), 0) + floor
                mu.append(m.tolist())
                inv.append(np.linalg.inv(c).ravel().tolist())
            out = f[[k for k in f.columns if k in keys]].copy()
            out["mu"], out["inv"] = mu, inv
            yield out

    kept = moments.select(*keys, "n", "sums", "products")
    schema = ", ".join([*(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys), "mu array<double>", "inv array<double>"])
    return kept.mapInPandas(invert, schema)


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Medians and spreads (quartiles), from histograms of mergeable sketches, as the start of the concentration."""
    p = len(STATS)
    q = rows.groupBy(*keys).agg(*[F.percentile_approx(s, [0.25, 0.5, 0.75], 2000).alias(f"q_{s}") for s in STATS])
    mu = F.array(*[F.col(f"q_{s}")[1] for s in STATS])
    spread = [F.pow((F.col(f"q_{s}")[2] - F.col(f"q_{s}")[0]) / 1.349, 2) + FLOOR[k] ** 2 for k, s in enumerate(STATS)]
    inv = F.array(*[(1 / spread[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)])
    return q.select(*keys, mu.alias("mu"), inv.alias("inv"))


def _concentrate(rows: DataFrame, keys: list[str], keep: float, steps: int) -> DataFrame:
    """The estimate of each group of ``rows``. Rows join estimates on a salted group, so a hot group is read by many tasks."""
    now = stage(_first(rows, keys), "mcd-start")
    factor = consistency(keep, len(STATS))
    for _ in range(steps):
        far = _with(rows, now, keys).withColumn("bin", F.least(F.floor(F.log1p(_distance()) * PER_UNIT * 4), F.lit(BINS)).cast("int"))
        bins = far.groupBy(*keys, "bin").agg(F.count("*").alias("n"))  # at most BINS + 1 rows of a group
        by_bin = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("b"), F.sum("n").alias("all"))
        until = F.aggregate(
            "b",
            F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(-1).alias("cut")),
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["seen"] < F.col("all") * keep, x["bin"]).otherwise(a["cut"]).alias("cut")),
        )["cut"]
        cuts = now.join(by_bin.select(*keys, until.alias("cut")), keys)
        near = _with(rows, cuts, keys).where(F.least(F.floor(F.log1p(_distance()) * PER_UNIT * 4), F.lit(BINS)) <= F.col("cut"))
        new = stage(_estimates(_moments(near, keys), keys, factor), "mcd-step")
        unstage(now)
        now = new
    return now


def _with(rows: DataFrame, of_group: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's estimate. The groups' table is small beside the rows but not bounded, so Spark chooses the
    join by its size; beyond the broadcast threshold, rows are dealt over 16 salts of their group."""
    salt = 16
    left = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salt)).cast("int"))
    right = of_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(right, [*keys, "salt"]).drop("salt")


def outliers(stats: DataFrame, lang: str = "lang", source: str = "source", keep: float = KEEP, steps: int = STEPS, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``stats`` (doc_id, lang, source, x0..x4) with ``distance`` (squared, robust) and ``level``: what its estimate covers
    (2: language and source, 1: language, 0: all). Rows beyond the chi-square quantile ``share`` are outliers.

    Null languages and sources are groups of their own. Ties and repeated rows weigh as rows do. An empty table gives
    an empty table.
    """
    rows = stats.withColumn("g_lang", F.coalesce(F.col(lang), F.lit("\x00"))).withColumn("g_source", F.coalesce(F.col(source), F.lit("\x00")))
    sizes = stage(rows.groupBy("g_lang", "g_source").agg(F.count("*").alias("n")), "mcd-sizes")
    langs = sizes.groupBy("g_lang").agg(F.sum("n").alias("in_lang"), (F.min("n") < least).alias("some_small"))
    level = F.when(F.col("n") >= least, 2).when(F.col("in_lang") >= least, 1).otherwise(0)
    named = sizes.join(langs, "g_lang").withColumn("level", level)
    any_small = named.agg(F.coalesce(F.min("level") == 0, F.lit(False)).alias("any_tiny"))  # one row
    own, of_lang, of_all = F.concat(F.lit("2"), "g_lang", F.lit("\x01"), "g_source"), F.concat(F.lit("1"), "g_lang"), F.lit("0")
    feeds = F.array_compact(
        F.array(
            F.when(F.col("level") == 2, own),
            F.when(F.col("some_small") & (F.col("in_lang") >= least), of_lang),
            F.when(F.col("any_tiny"), of_all),
        )
    )
    groups = named.crossJoin(F.broadcast(any_small)).select(
        "g_lang", "g_source", "level", F.when(F.col("level") == 2, own).when(F.col("level") == 1, of_lang).otherwise(of_all).alias("g"), feeds.alias("feeds")
    )
    keyed = _with(rows, stage(groups, "mcd-groups"), ["g_lang", "g_source"])
    made = stage(keyed.select("doc_id", F.explode("feeds").alias("g"), *STATS), "mcd-rows")
    found = _concentrate(made, ["g"], keep, steps)
    judged = _with(keyed, found, ["g"]).withColumn("distance", _distance())
    return judged.drop("mu", "inv", "g_lang", "g_source", "g", "feeds").withColumn("outlier", F.col("distance") > chi_square_quantile(share, len(STATS)))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, the five counts, base_failed, kept, distance, level) for every row of ``docs``.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated 5-word windows. Estimates are made on
    the rows that pass. Null and empty texts have no words and fail.
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")).alias("key"), F.col(text_col).alias("text"))
    made = text_counts(keyed, "key", "text").select("doc_id.*", *COUNTS, "n_lines").withColumnRenamed("id", "doc_id")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    made = stage(made.withColumn("base_failed", failed).select("*", *transformed()), "text-counts")
    good = outliers(made.where("not base_failed"))
    none = made.where("base_failed").select("*", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("distance"), F.lit(True).alias("outlier"))
    return good.unionByName(none).select("doc_id", *COUNTS, "base_failed", (~F.col("outlier")).alias("kept"), "distance", "level")
