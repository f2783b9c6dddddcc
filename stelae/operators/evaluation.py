"""Evaluation: classification, ranking, calibration, agreement, resampling by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def per_class(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) for every label seen on either side; 0/0 is 0."""
    pairs = df.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.col("g").alias("label"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("g") != F.col("p"), F.col("n")).otherwise(0).alias("fn")).unionByName(
        pairs.where("g <> p").select(F.col("p").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    )
    out = sides.groupBy("label").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def overall(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(n, accuracy, macro_f1)."""
    acc = df.agg(F.count("*").alias("n"), F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy"))
    return acc.crossJoin(F.broadcast(per_class(df, gold, predicted).agg(F.avg("f1").alias("macro_f1"))))


def precision_at(hits: DataFrame, query: str, relevant: Column, ks: list[int]) -> DataFrame:
    """(query, p_at_k..., reciprocal_rank) of ranked hits (column ``rank`` from 1)."""
    made = [(F.sum(F.when((F.col("rank") <= k) & relevant, 1).otherwise(0)) / k).alias(f"p_at_{k}") for k in ks]
    first = F.min(F.when(relevant, F.col("rank")))
    return hits.groupBy(query).agg(*made, F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"))


def ndcg(hits: DataFrame, query: str, relevant: Column, totals: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg) at ``k``; the ideal ranks all relevant rows (``totals``: query, n) first, capped at k."""
    gain = hits.where(F.col("rank") <= k).groupBy(query).agg(F.sum(F.when(relevant, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    joined = gain.join(totals, query)
    return joined.select(query, F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def random_precision(vocabulary: Column, relevant: Column, k: int) -> Column:
    """The chance that k draws of a vocabulary hold a relevant word: 1 - C(v - f, k) / C(v, k), as a product."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(vocabulary - relevant - i, F.lit(0)) / (vocabulary - i))
    return 1 - miss


def calibration(df: DataFrame, score: str, correct: Column, cuts: list[float]) -> DataFrame:
    """(cut, n, share, accuracy) of rows that score at each cut or more."""
    at = [F.col(score) >= c for c in cuts]
    ok = correct.cast("double")
    each = [F.struct(F.lit(c).alias("cut"), F.count(F.when(a, 1)).alias("n"), F.avg(F.when(a, ok)).alias("accuracy")) for c, a in zip(cuts, at)]
    one = df.agg(F.count("*").alias("all_rows"), F.array(*each).alias("x")).select("all_rows", F.explode("x").alias("x"))
    return one.where("x.n > 0").select("x.cut", "x.n", (F.col("x.n") / F.col("all_rows")).alias("share"), "x.accuracy")


def krippendorff_alpha(ratings: DataFrame, item: str, value: str) -> DataFrame:
    """(alpha, pairable): nominal agreement of ratings in long form; nulls and lone ratings fall out; null where undefined.

    From counts of each value of each item: coincidences of c and k are n_c * n_k / (m - 1), and n_c * (n_c - 1) / (m - 1) of c with itself.
    """
    counts = ratings.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count("*").alias("n"))
    m = counts.groupBy(item).agg(F.sum("n").alias("m")).where("m > 1")
    live = counts.join(m, item)
    agree = live.agg(F.sum(F.col("n") * (F.col("n") - 1) / (F.col("m") - 1)).alias("agree"))
    marginal = live.groupBy(value).agg(F.sum("n").alias("nv"))
    total = marginal.agg(F.sum("nv").alias("t"), F.sum(F.col("nv") * (F.col("nv") - 1)).alias("same"))
    out = agree.crossJoin(F.broadcast(total))
    observed = 1 - F.col("agree") / F.col("t")
    expected = 1 - F.col("same") / (F.col("t") * (F.col("t") - 1))
    return out.select(F.when(expected > 0, 1 - observed / expected).alias("alpha"), F.col("t").alias("pairable"))


def resample_weight(id_col: str | Column, replica: Column, seed: int = 42) -> Column:
    """How often a row is drawn in a replica: Poisson(1) from the first 8 hex digits of an MD5, the same everywhere."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    u = F.conv(F.substring(F.md5(F.concat_ws("|", c.cast("string"), replica.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    out, p, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        out = out + F.when(u >= total, 1).otherwise(0)
        p /= k + 1
    return out


def bootstrap_means(df: DataFrame, id_col: str, values: list[str], replicas: int, seed: int = 42) -> DataFrame:
    """(replica, means...): each row counts by its weight in each replica, one aggregation for all replicas."""
    rows = df.select(id_col, *values, F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica"))
    rows = rows.withColumn("w", resample_weight(id_col, F.col("replica"), seed))
    return rows.groupBy("replica").agg(*[(F.sum(F.col("w") * F.col(v)) / F.sum("w")).alias(v) for v in values])


def percentile_interval(replicates: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """(low, high): sorted replicates at int(a / 2 * n) and int((1 - a / 2) * n) - 1. Replicas are few by construction."""
    a = 1 - share
    s = replicates.agg(F.array_sort(F.collect_list(value)).alias("s"))
    n = F.size("s")
    at = lambda p: F.element_at("s", F.least(F.greatest(F.floor(p * n).cast("int") + 1, F.lit(1)), n))
    return s.select(at(F.lit(a / 2)).alias("low"), F.element_at("s", F.greatest(F.floor(F.lit(1 - a / 2) * n).cast("int"), F.lit(1))).alias("high"))


def paired_bootstrap(df: DataFrame, id_col: str, a: str, b: str, replicas: int, seed: int = 42) -> DataFrame:
    """(delta, p_one_sided): the mean difference a - b, and the share of replicas where it is 0 or less."""
    means = bootstrap_means(df, id_col, [a, b], replicas, seed)
    p = means.agg(F.avg((F.col(a) - F.col(b) <= 0).cast("double")).alias("p_one_sided"))
    return df.agg((F.avg(a) - F.avg(b)).alias("delta")).crossJoin(F.broadcast(p))


def character_accuracy(gold: Column, guess: Column) -> Column:
    """Share of the gold's characters that the guess has at the same place."""
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(gold), F.lit(1))), F.lit(0), lambda s, i: s + F.when(F.substring(gold, i, F.lit(1)) == F.substring(guess, i, F.lit(1)), 1).otherwise(0)
    )
    return F.when(F.length(gold) > 0, same / F.length(gold)).otherwise(0.0)


def median_rank(hits: DataFrame, by: str, rank: Column, miss: int) -> DataFrame:
    return hits.groupBy(by).agg(F.median(F.coalesce(rank, F.lit(miss))).alias("median_rank"))


def fail_below(metrics: dict[str, float], gates: str) -> list[str]:
    """Names of gates ``name=least,...`` that the metrics do not reach; unknown names fail."""
    out = []
    for g in filter(None, (x.strip() for x in gates.split(","))):
        name, _, least = g.partition("=")
        if metrics.get(name.strip(), float("-inf")) < float(least):
            out.append(name.strip())
    return out


def top_share(df: DataFrame, by: str, order: list) -> DataFrame:
    """The share of each group's best row in the group's total (column ``n``)."""
    w = Window.partitionBy(by)
    return df.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order))).where("_r = 1").drop("_r")
