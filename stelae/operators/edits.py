"""The nearest string by edits: joins on parts of strings for ever more edits, until each string has its best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import fixed

#: Edits that the rounds allow; what they leave is compared with all strings that share a letter.
ROUNDS = (1, 3)


def _parts(text: Column, k: int) -> Column:
    """The k + 1 even parts of a string as (size of the string, number of the part, its place from 0, letters)."""
    n = F.length(text)
    cut = lambda i: F.floor(i * n / (k + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(n.alias("size"), i.alias("part"), F.substring(text, cut(i) + 1, cut(i + 1) - cut(i)).alias("letters")))


def within_edits(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(a, b, edits) of distinct strings ``a`` and ``b`` within ``k`` edits: of the k + 1 parts of ``b`` one is untouched, so it stands in ``a`` at most
    k places from where it stands in ``b``, and the lengths differ by k at most. What meets on a part is counted out."""
    b = right.select("b", F.explode(_parts(F.col("b"), k)).alias("x")).select("b", "x.*")
    n = F.length("a")
    sizes = F.sequence(F.greatest(n - k, F.lit(0)), n + k)

    def at(size: Column, i: Column) -> Column:
        begin = F.floor(i * size / (k + 1)).cast("int")
        wide = F.floor((i + 1) * size / (k + 1)).cast("int") - begin
        low, high = F.greatest(begin - k, F.lit(0)), F.least(begin + k, n - wide)
        places = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.struct(size.alias("size"), i.alias("part"), F.substring(F.col("a"), p + 1, wide).alias("letters")))

    every = F.flatten(F.transform(sizes, lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: at(s, i)))))
    a = left.select("a", F.explode(F.array_distinct(every)).alias("x")).select("a", "x.*")
    met = a.join(b, ["size", "part", "letters"]).select("a", "b").distinct()
    return met.withColumn("edits", F.levenshtein("a", "b", k)).where("edits >= 0")


def _score() -> Column:
    return 1 - F.col("edits") / F.greatest(F.length("a"), F.length("b"))


def _best(scored: DataFrame) -> DataFrame:
    m = F.min(F.struct((-F.col("score")).alias("less"), "b"))
    return scored.groupBy("a").agg(m.alias("m")).select("a", "m.b", (-F.col("m.less")).alias("score"))


def sharing_a_letter(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of distinct strings that have a letter in common, each pair once, where it meets on the least such letter."""
    letters = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")))
    a = left.select("a", letters(F.col("a")).alias("_a")).withColumn("letter", F.explode("_a"))
    b = right.select("b", letters(F.col("b")).alias("_b")).withColumn("letter", F.explode("_b"))
    return a.join(b, "letter").where(F.array_min(F.array_intersect("_a", "_b")) == F.col("letter")).select("a", "b")


def nearest_by_edits(left: DataFrame, right: DataFrame, left_text: str, right_text: str) -> DataFrame:
    """(a, b, score): for each distinct string of ``left`` the string of ``right`` with the highest 1 - edits / longer length, of equals the
    lesser; exact. Null strings are left out; nothing in ``right`` gives no rows.

    A string is done in the round of k edits once its best there beats what any string beyond k edits can score, n / (n + k + 1) for n
    letters. The rest meet what shares a letter with them; what shares none has a score of 0.
    """
    rest = fixed(left.select(F.col(left_text).alias("a")).where("a is not null").distinct())
    others = fixed(right.select(F.col(right_text).alias("b")).where("b is not null").distinct())
    done = None
    for k in ROUNDS:
        best = _best(within_edits(rest, others, k).withColumn("score", _score().try_cast("double"))).where("score is not null")
        n = F.length("a")
        sure = fixed(best.where((F.col("score") == 1) | (F.col("score") > n / (n + k + 1))))
        done = sure if done is None else done.unionByName(sure)
        rest = rest.join(sure.select("a"), "a", "left_anti")
    far = sharing_a_letter(rest, others).withColumn("edits", F.levenshtein("a", "b")).withColumn("score", _score())
    least = others.agg(F.min("b").alias("b")).first().b
    none = rest.select("a", F.lit(least).alias("b")).where("b is not null").withColumn("edits", F.levenshtein("a", "b"))
    none = none.withColumn("score", F.when(F.greatest(F.length("a"), F.length("b")) == 0, 1.0).otherwise(_score().try_cast("double")))
    return done.unionByName(_best(far.select("a", "b", "score").unionByName(none.select("a", "b", "score"))))
