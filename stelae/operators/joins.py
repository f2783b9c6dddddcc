"""Joins: alternatives as unions of equi-joins, clusters over shared identifiers, cascades, interval lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import fixed


def join_on_either(left: DataFrame, right: DataFrame, left_key: str, right_keys: list[str]) -> DataFrame:
    """Rows of ``left`` and ``right`` where ``left_key`` equals any of ``right_keys``, each pair once: a union of equi-joins
    in place of a nested loop over a disjunction. A pair is the first alternative's that it meets, so repeated rows stay repeated."""
    key = F.col(left_key)
    parts = [left.join(right, reduce(lambda a, k: a & ~key.eqNullSafe(F.col(k)), right_keys[:i], key == F.col(k))) for i, k in enumerate(right_keys)]
    return reduce(DataFrame.unionByName, parts)


def shared_identifiers(df: DataFrame, id_col: str, identifiers: list[str]) -> DataFrame:
    """(id, mate): rows that hold any identifier value of the row ``id``, whichever column holds it; blank values never match. A pair is made
    at the least value that both hold, so pairs, which may be many more than rows, are neither kept nor dealt out to find repeats."""
    held = df.select(id_col, F.explode(F.array(*[F.col(c).cast("string") for c in identifiers])).alias("value")).where(F.trim("value") != "")
    held = held.groupBy(id_col).agg(F.array_sort(F.collect_set("value")).alias("_held"))
    rows = held.select(id_col, "_held", F.posexplode("_held").alias("_at", "value"))
    mates = held.select(F.col(id_col).alias("mate"), F.col("_held").alias("_theirs"), F.explode("_held").alias("value"))
    at = F.col("_at")
    before = F.when(at == 0, False).when(at == 1, F.array_contains("_theirs", F.element_at("_held", 1))).otherwise(F.arrays_overlap(F.slice("_held", 1, at), "_theirs"))
    return rows.join(mates.hint("merge"), "value").where((F.col(id_col) != F.col("mate")) & ~before).select(id_col, "mate")


def identifier_classes(df: DataFrame, id_col: str, identifiers: list[str]) -> DataFrame:
    """(id, class, n_mates): rows that hold a value in common, directly or through others, are one class, named by its least id; ``n_mates`` are
    the other rows that hold one of the row's values, each counted once for each value. A value costs a link for each row that
    holds it, not a pair for each two: its rows are linked to the least of them."""
    from .graph import classes

    held = fixed(df.select(id_col, F.explode(F.array(*[F.col(c).cast("string") for c in identifiers])).alias("value")).where(F.trim("value") != "").distinct())
    least = held.groupBy("value").agg(F.min(id_col).alias("_least"), (F.count("*") - 1).alias("_mates"))
    linked = held.join(least, "value")
    mates = linked.groupBy(id_col).agg(F.sum("_mates").alias("n_mates"))
    found = classes(linked, id_col, "_least").withColumnsRenamed({"node": id_col})
    return found.join(mates, id_col).select(id_col, "class", "n_mates")


def unordered_pairs(df: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """(keys, a, b) with a < b of rows that share a non-null key."""
    left = df.select(*key, F.col(id_col).alias("a"))
    right = df.select(*key, F.col(id_col).alias("b"))
    return left.join(right, key).where("a < b")


def counts_of(left: DataFrame, right: DataFrame, key: str, name: str = "n") -> DataFrame:
    """``left`` with the number of ``right`` rows of its key, 0 where there are none."""
    n = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def first_value(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """For each key, the first value of each column that is neither null nor blank, in ``order``."""
    picks = [F.min_by(F.col(c), F.when(F.trim(F.col(c).cast("string")) != "", F.col(order))).alias(c) for c in columns]
    return df.groupBy(key).agg(*picks)


def enrich(df: DataFrame, facts: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Fill columns of ``df`` from ``facts`` by key; a value that ``df`` has stays."""
    found = first_value(facts, key, columns, order)
    out = df.join(found.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    for c in columns:
        known = F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") if c in df.columns else F.lit(False)
        out = out.withColumn(c, F.when(known, F.col(c) if c in df.columns else F.lit(None)).otherwise(F.col(f"_{c}"))).drop(f"_{c}")
    return out


def cascade(df: DataFrame, lookups: list[tuple[str, DataFrame, str, str]], value: str, none: str = "missing") -> DataFrame:
    """The first lookup with a value wins: ``lookups`` are (reason, table, key, value column); adds ``value`` and ``reason``."""
    out, found, reason = df, [], F.lit(none)
    for k, (name, right, key, col) in enumerate(lookups):
        out = out.join(right.select(F.col(key), F.col(col).alias(f"_v{k}")), key, "left")
        found.append(F.col(f"_v{k}"))
    for k in range(len(lookups) - 1, -1, -1):
        reason = F.when(found[k].isNotNull(), lookups[k][0]).otherwise(reason)
    return out.withColumn(value, F.coalesce(*found)).withColumn("reason", reason).drop(*[f"_v{k}" for k in range(len(lookups))])


def period_of(year: Column, tiles: list[tuple[str, int, int]], umbrella: tuple[str, int, int] | None = None) -> Column:
    """The first closed interval that holds the year, else the umbrella, else null."""
    out = F.lit(None).cast("string")
    if umbrella:
        out = F.when(year.between(umbrella[1], umbrella[2]), umbrella[0])
    for name, lo, hi in reversed(tiles):
        out = F.when(year.between(lo, hi), name).otherwise(out)
    return out


def containing_intervals(df: DataFrame, value: str, intervals: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """All intervals that hold the value: an equi-join on cells of ``width`` that the interval covers, then the exact test.
    Intervals may overlap; pick ``width`` near their usual length."""
    cell = lambda c: F.floor(F.col(c) / width)
    cut = intervals.withColumn("_cell", F.explode(F.sequence(cell(lo), cell(hi))))
    return df.withColumn("_cell", cell(value)).join(cut, "_cell").where(F.col(value).between(F.col(lo), F.col(hi))).drop("_cell")


def merge(old: DataFrame, new: DataFrame, key: str, preserve: list[str] | None = None) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` by key; in ``preserve`` columns a null of ``new`` keeps the old value."""
    if preserve:
        kept = old.select(key, *[F.col(c).alias(f"_{c}") for c in preserve])
        new = new.join(kept, key, "left")
        for c in preserve:
            new = new.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}"))).drop(f"_{c}")
    return old.join(new, key, "left_anti").unionByName(new.select(*old.columns))


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti").select(*old.columns))


def earlier_source_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Union by name; of rows that share a key, the earliest source's stays."""
    parts = [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    w = Window.partitionBy(key).orderBy("_source")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_source")


def word_overlap(left: DataFrame, right: DataFrame, id_left: str, id_right: str, words: str, least: int = 2, long_word: int = 6) -> DataFrame:
    """(id_left, id_right, shared): ``least`` shared words of over 3 letters, or one of ``long_word`` letters; the first match per left row.

    A match is a long word or (for ``least`` of 2) two short ones that both rows have, so the first row of each such key is all that is
    asked of ``right``; for a greater ``least`` all rows that share a word meet.
    """

    def held(df: DataFrame, key: str, name: str) -> DataFrame:
        each = df.select(key, F.explode(words).alias("w")).where(F.length("w") > 3)
        return each.groupBy(key).agg(F.array_sort(F.collect_set("w")).alias(name))

    a, b = held(left, id_left, "_a"), held(right, id_right, "_b")
    if least > 2:
        met = a.select(id_left, F.explode("_a").alias("w")).join(b.select(id_right, F.explode("_b").alias("w")), "w")
        met = met.groupBy(id_left, id_right).agg(F.count("*").alias("shared"), F.max(F.length("w")).alias("longest"))
        met = met.where((F.col("shared") >= least) | (F.col("longest") >= long_word))
        w = Window.partitionBy(id_left).orderBy(id_right)
        return met.withColumn("n", F.row_number().over(w)).where("n = 1").select(id_left, id_right, "shared")

    def keys(name: str) -> Column:
        alone = F.filter(name, lambda x: F.length(x) >= long_word) if least == 2 else F.col(name)
        out = F.transform(alone, lambda x: F.struct(x.alias("x"), F.lit("").alias("y")))
        if least < 2:
            return out
        short = F.filter(name, lambda x: F.length(x) < long_word)
        pairs = F.transform(short, lambda x, i: F.transform(F.slice(short, i + 2, F.size(short)), lambda y: F.struct(x.alias("x"), y.alias("y"))))
        return F.concat(out, F.flatten(pairs))

    first = b.select(id_right, F.explode(keys("_b")).alias("_key")).groupBy("_key").agg(F.min(id_right).alias(id_right))
    best = a.select(id_left, F.explode(keys("_a")).alias("_key")).join(first.hint("merge"), "_key").groupBy(id_left).agg(F.min(id_right).alias(id_right))
    met = best.join(a.hint("merge"), id_left).join(b.hint("merge"), id_right)
    return met.select(id_left, id_right, F.size(F.array_intersect("_a", "_b")).cast("bigint").alias("shared"))
