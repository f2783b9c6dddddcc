"""Curation: leakage, splits without shared texts, folds, jury decisions, moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import running_sum


def hash_order(id_col: str, seed: int = 42) -> Column:
    """A fixed shuffle that any engine can repeat: MD5 of id and seed."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary"))


def leaks(train: DataFrame, test: DataFrame, key: str, id_col: str, label_col: str) -> DataFrame:
    """Test rows whose key occurs in train: (id, twins, same_label, single_token). Train keys are counted before the join."""
    seen = train.groupBy(key).agg(F.count("*").alias("twins"), F.collect_set(label_col).alias("labels"))
    met = test.join(seen, key)
    return met.select(id_col, "twins", F.array_contains("labels", F.col(label_col)).alias("same_label"), (~F.col(key).contains(" ")).alias("single_token"))


def lemma_hits(docs: DataFrame, id_col: str, tokens: Column, lemmas: DataFrame, lemma_col: str) -> DataFrame:
    """(lemma, documents, occurrences) of evaluation lemmas in training texts."""
    words = docs.select(id_col, F.explode(tokens).alias(lemma_col)).groupBy(id_col, lemma_col).agg(F.count("*").alias("n"))
    return words.join(lemmas.select(lemma_col).distinct(), lemma_col).groupBy(lemma_col).agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


def first_in_hash_order(df: DataFrame, key: str, id_col: str, wanted: Column, seed: int = 42) -> DataFrame:
    """The first rows of each key in hash order, as many as ``wanted`` says, an expression of the key's number of rows ``_n``; ties by id.

    No row is ranked but those near the cut: hashes are counted in 65,536 buckets of each key, rows of the buckets before the cut are
    in, and of the one that holds it (a 65,536th of a key's rows) the first are. Null keys are left out.
    """
    rows = df.where(F.col(key).isNotNull()).withColumn("_o", hash_order(id_col, seed)).withColumn("_b", F.conv(F.substring("_o", 1, 4), 16, 10).cast("int"))
    so_far = Window.partitionBy(key).orderBy("_b")  # at most a row for each bucket
    counted = rows.groupBy(key, "_b").agg(F.count("*").alias("_c"))
    placed = counted.select(key, "_b", "_c", F.sum("_c").over(so_far).alias("_upto"), F.sum("_c").over(Window.partitionBy(key)).alias("_n"))
    cut = placed.withColumn("_k", wanted).where("_upto >= _k").groupBy(key).agg(F.min_by(F.struct(F.col("_b").alias("at"), (F.col("_k") - F.col("_upto") + F.col("_c")).alias("more")), "_b").alias("_cut"))
    met = rows.join(cut, key, "left")  # a key of fewer rows than wanted has no cut
    whole = met.where(F.col("_cut").isNull() | (F.col("_b") < F.col("_cut.at"))).select(*df.columns)
    near = met.where(F.col("_b") == F.col("_cut.at")).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_o", id_col)))
    return whole.unionByName(near.where(F.col("_r") <= F.col("_cut.more")).select(*df.columns))


def text_disjoint_split(df: DataFrame, id_col: str, label_col: str, key_col: str, share: float, least: int = 2, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: of each label a share (at least ``least`` rows) in hash order is test, and so is every row that
    shares a text key with one of them, so that no text is on both sides."""
    drawn = first_in_hash_order(df.select(id_col, label_col, key_col), label_col, id_col, F.greatest(F.lit(least), F.floor(F.col("_n") * share)), seed)
    keys = drawn.select(key_col).distinct().withColumn("_t", F.lit(True))
    return df.join(keys, key_col, "left").withColumn("split", F.when(F.col("_t"), "test").otherwise("train")).drop("_t")


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """(group, fold): groups whole, dealt in turn within their majority label, each label beginning at another fold."""
    n = df.groupBy(group, label).agg(F.count("*").alias("n"))
    major = n.groupBy(group).agg(F.max_by(label, F.struct("n", label)).alias("major"))
    labels = major.select("major").distinct().withColumn("_l", F.dense_rank().over(Window.orderBy("major")) - 1)  # as many rows as labels
    ranked = running_sum(major.withColumn("_o", hash_order(group, seed)), ["major"], ["_o", group], F.lit(1), "_n")
    dealt = ranked.join(labels, "major").withColumn("_r", F.col("_n") - 1)
    return dealt.select(group, "major", F.pmod(F.col("_r") + F.col("_l"), F.lit(k)).cast("int").alias("fold"))


def jury(ratings: DataFrame, item: str, rater: str, label: str, confidence: str, floor: float = 0.7) -> DataFrame:
    """(item, raters, decision, gold): errors are left out and bar an item from gold; all unsure; one label at the floor: candidate gold; else the queue."""
    valid = (F.col(label) != "api_error") & F.col(label).isNotNull()
    g = ratings.groupBy(item).agg(
        F.count(F.when(valid, 1)).alias("raters"),
        F.count(F.when(~valid, 1)).alias("errors"),
        F.count_distinct(F.when(valid, F.col(label))).alias("kinds"),
        F.min(F.when(valid, F.col(label))).alias("one"),
        F.min(F.when(valid, F.col(confidence))).alias("sure"),
    )
    unsure = (F.col("kinds") == 1) & (F.col("one") == "unsure")
    gold = (F.col("kinds") == 1) & (F.col("errors") == 0) & (F.col("sure") >= floor)
    decision = F.when(unsure, "all_unsure").when(gold, "candidate_gold").otherwise("queue")
    return g.select(item, "raters", decision.alias("decision"), F.when(decision == "candidate_gold", F.col("one")).alias("gold"))


def disagreements(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """(a, b, n): items on which two labels were both given, a < b."""
    each = ratings.select(item, label).where(F.col(label).isNotNull()).distinct()
    return each.select(item, F.col(label).alias("a")).join(each.select(item, F.col(label).alias("b")), item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def wide_ratings(ratings: DataFrame, item: str, rater: str, raters: list[str], columns: list[str]) -> DataFrame:
    """One row per item, columns ``{rater}_{column}``; of repeated ratings the greatest value."""
    made = [F.max(F.when(F.col(rater) == r, F.col(c))).alias(f"{r}_{c}") for r in raters for c in columns]
    return ratings.groupBy(item).agg(*made)


def moderate(submitted: DataFrame, id_col: str, key: str, email: str, at: str, attested: DataFrame, cap: int) -> DataFrame:
    """``decision`` of each submission, in order: attested already; a key pending from before; over ``cap`` in 24 hours by the email; else pending."""
    day = Window.partitionBy(email).orderBy(F.unix_micros(at)).rangeBetween(-86_400_000_000, 0)
    first = submitted.groupBy(key).agg(F.min(F.struct(at, id_col)).alias("_first"))
    known = attested.select(key).distinct().withColumn("_known", F.lit(True))
    rows = submitted.withColumn("_recent", F.count("*").over(day)).join(first, key).join(known, key, "left")
    later = F.struct(at, id_col) > F.col("_first")
    decision = F.when(F.col("_known"), "attested").when(later, "duplicate").when(F.col("_recent") > cap, "capped").otherwise("pending")
    return rows.withColumn("decision", decision).drop("_recent", "_first", "_known")


def allocate(strata: DataFrame, stratum: str, n: str, total: int, floor: int) -> DataFrame:
    """(stratum, quota): ``floor`` each, the rest in proportion, remainders to the largest fractions."""
    t = strata.agg(F.sum(n).alias("_t"), F.count("*").alias("_k"))
    s = strata.crossJoin(F.broadcast(t))
    left = F.greatest(F.lit(total) - F.col("_k") * floor, F.lit(0))
    s = s.withColumn("_x", left * F.col(n) / F.col("_t")).withColumn("_b", F.floor("_x")).withColumn("_l", left)
    spare = s.agg((F.max("_l") - F.sum("_b")).alias("_s"))
    w = Window.orderBy(F.desc(F.round(F.col("_x") - F.col("_b"), 9)), stratum)  # strata are few
    s = s.crossJoin(F.broadcast(spare)).withColumn("_r", F.row_number().over(w))
    return s.select(stratum, (F.lit(floor) + F.col("_b") + F.when(F.col("_r") <= F.col("_s"), 1).otherwise(0)).cast("bigint").alias("quota"))


def provenance_tier(place: Column) -> Column:
    """Named places are documented; blanks count as a name, as only null and '' are absence here."""
    return F.when(place.isNull() | (place == ""), "unknown").otherwise("documented")
