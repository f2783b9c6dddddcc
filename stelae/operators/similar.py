"""Near-equal strings of two sets: a lossless filter by shared pairs of letters, then the ratio of matching blocks."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stelae.functions.lazy import pandas_udf


def shared_at_least(total: int, least: float) -> int:
    """Pairs of neighbouring letters that two strings of ``total`` letters share if their ratio reaches ``least``: they match in
    ceil(least * total / 2) letters, every letter unmatched breaks at most one block, and a block of m letters has m - 1 pairs."""
    return 3 * math.ceil(least * total / 2 - 1e-9) - total - 1


def _filters(least: float) -> None:
    for total in range(2, 400):
        matched = math.ceil(least * total / 2 - 1e-9)
        if matched <= total // 2 and shared_at_least(total, least) < 1 and 2 * matched != total:
            raise ValueError(f"ratio {least} is too low: strings of {total} letters in all may reach it without a shared pair of letters")


def numbered_pairs(text: Column) -> Column:
    """Each pair of neighbouring letters with the number of its occurrence, so that shared elements count as in multisets."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    numbered = F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda q: q == p)).cast("string")))
    return F.when(F.length(text) >= 2, numbered).otherwise(F.array().cast("array<string>"))


@pandas_udf("double")
def _ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio, or null below ``least``; its upper bounds are tried first."""
    out, held = [], SequenceMatcher(None)
    for x, y, t in zip(a, b, least):
        held.set_seqs(x, y)
        good = held.real_quick_ratio() >= t and held.quick_ratio() >= t
        r = held.ratio() if good else 0.0
        out.append(r if r >= t else None)
    return pd.Series(out, dtype="float64")


def candidate_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): from distinct strings ``a`` and ``b``, all pairs that may reach the ratio. Of a string's pairs of letters, in one order of
    all, rarest first, only so many meet as the rest is too few to share; a string meets strings of fitting lengths alone."""
    _filters(least)
    counted = left.select(F.col("a").alias("t")).unionByName(right.select(F.col("b").alias("t"))).select(F.explode(numbered_pairs(F.col("t"))).alias("g")).groupBy("g").agg(F.count("*").alias("f"))
    shortest = 2 / (2 - least)  # of both strings together, for each letter of this one

    def prefix(df: DataFrame, name: str) -> DataFrame:
        size = F.length(name)
        need = F.greatest(F.ceil((1.5 * least - 1) * shortest * size - 1 - 1e-9), F.lit(1))
        each = df.select(name, size.alias(f"{name}_size"), (size - 1 - need + 1).alias("keep"), F.explode(numbered_pairs(F.col(name))).alias("g")).join(counted, "g")
        order = Window.partitionBy(name).orderBy("f", "g")  # one string's pairs
        return each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.col("keep")).select("g", name, f"{name}_size")

    met = prefix(left, "a").join(prefix(right, "b"), "g")
    fits = F.least("a_size", "b_size") * (2 - least) >= F.greatest("a_size", "b_size") * least - 1e-9
    return met.where(fits).select("a", "b").distinct()


def near_equal(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_id: str, right_text: str, least: float = 0.85) -> DataFrame:
    """(left_id, right_id, ratio): for each row of ``left`` the row of ``right`` whose text is most like its own, at ``least`` or more; of
    equal ratios the lesser text, of equal texts the lesser id. Blank and null texts match nothing. Equal texts are one in all that
    is compared, so rows of one text cost a row each, not their product."""
    texts = lambda df, id_col, text, name: df.select(F.col(id_col).alias("_id"), F.col(text).alias(name)).where(F.trim(name) != "")
    rows, others = texts(left, left_id, left_text, "a"), texts(right, right_id, right_text, "b").groupBy("b").agg(F.min("_id").alias(right_id))
    equal = rows.join(others, F.col("a") == F.col("b")).select(F.col("_id").alias(left_id), right_id, F.lit(1.0).alias("ratio"))
    rest = rows.join(others, F.col("a") == F.col("b"), "left_anti")
    scored = candidate_pairs(rest.select("a").distinct(), others.select("b"), least).withColumn("ratio", _ratio("a", "b", F.lit(least))).where("ratio is not null")
    best = scored.groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "b")).alias("m")).select("a", "m.b", (-F.col("m.less")).alias("ratio"))
    near = rest.join(best.join(others, "b"), "a").select(F.col("_id").alias(left_id), right_id, "ratio")
    return equal.unionByName(near)
