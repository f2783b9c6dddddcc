"""Vectors: exact neighbours for stated queries, fusion of rankings, centring, approximate neighbours, near-duplicates by n-gram cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .nearest import nearest

#: Query rows sent to every task at once, about, and bytes of their numbers.
QUERY_BLOCK, QUERY_BYTES = 4096, 32 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def top_k(vectors: DataFrame, id_col: str, vec_col: str, query: list[float], k: int) -> DataFrame:
    """(id, score): the ``k`` nearest by cosine; each task keeps k rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(vec_col), q).alias("score")).where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def neighbours(queries: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, k: int, same: list[str] | None = None, differ: list[str] | None = None) -> DataFrame:
    """(query, id, score, rank): for every query row its ``k`` nearest others, by cosine, exactly.

    ``queries`` is a stated set, counted here and sent in blocks of about QUERY_BLOCK rows by hash of the id, each in one pass over ``vectors``.
    With ``same``, partition columns must agree; with ``differ``, they must not. A task multiplies a block with its rows, keeps k rows of each
    query, and these alone are ranked. Vectors of different lengths have no cosine and never meet.
    """
    same, differ = same or [], differ or []
    rows = vectors.select(id_col, vec_col, *same, *differ)
    found = None
    for block in query_blocks(queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("_q"), *same, *differ)):
        best = nearest(rows, block, k, len(same))
        found = best if found is None else found.unionByName(best)
    return ranked(found, id_col, k)


def query_blocks(queries: DataFrame):
    """The rows (query, vector, ...) block by block, by hash of the id: QUERY_BLOCK of them or QUERY_BYTES, about; one at least."""
    n, wide = queries.agg(F.count("*"), F.max(F.size(queries.columns[1]))).first()
    blocks = max(1, -(-n // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(wide or 1, 1))))))
    for b in range(blocks):
        yield (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)).toArrow()


def ranked(found: DataFrame, id_col: str, k: int) -> DataFrame:
    """(query, id, score, rank) of the ``k`` best of (query, id, score)."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), id_col)
    return found.withColumnRenamed("id", id_col).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def margin_gate(hits: DataFrame, query_col: str, least: float) -> DataFrame:
    """Hits of queries whose best score leads the second by ``least`` or more."""
    w = Window.partitionBy(query_col).orderBy("rank")
    held = hits.withColumn("_m", F.when(F.col("rank") == 1, F.struct((F.col("score") - F.lead("score").over(w)).alias("margin"))))
    held = held.withColumn("_m", F.first("_m").over(w)).where("_m is not null").withColumn("margin", F.col("_m.margin")).drop("_m")
    return held.where(F.coalesce(F.col("margin") >= least, F.lit(True))).select(query_col, *[c for c in hits.columns if c != query_col], "margin")


def reciprocal_ranks(df: DataFrame, order: list[Column], id_col: str, name: str, most: int, k: int = 60) -> DataFrame:
    """(id, name): 1 / (k + rank) of the first ``most`` rows, ranks from 0."""
    top = df.orderBy(*order).limit(most)
    return top.withColumn("_r", F.row_number().over(Window.orderBy(*order)) - 1).select(id_col, (1.0 / (k + F.col("_r"))).alias(name))


def fuse(a: DataFrame, b: DataFrame, id_col: str, limit: int) -> DataFrame:
    """(id, score): reciprocal rank fusion of two rankings (columns ``a`` and ``b``); a row of one alone counts as that."""
    both = a.join(b, id_col, "full")
    score = F.coalesce(F.col("a"), F.lit(0.0)) + F.coalesce(F.col("b"), F.lit(0.0))
    return both.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def centred(df: DataFrame, group: str, id_col: str, vec_col: str) -> DataFrame:
    """(group, id, vector): less the group's mean, then of length 1; a zero vector stays zero. Means are partial sums by position."""
    cells = df.select(group, F.posexplode(vec_col).alias("pos", "x"))
    means = cells.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda c: c["m"]).alias("centre"))
    moved = df.join(centre, group).withColumn("v", F.zip_with(vec_col, "centre", lambda x, c: x - c))
    return moved.select(group, id_col, unit(F.col("v")).alias("vector"))


def principal_directions(df: DataFrame, vec_col: str, k: int) -> list[list[float]]:
    """The leading ``k`` directions of the second moments. Each task adds up one d x d matrix over its rows, so d * d numbers a task are
    all that is moved; their sum alone comes to the driver. Null vectors are left out; all others must have one length."""
    import numpy as np
    import pyarrow as pa

    def partial(batches):
        total = None
        for batch in batches:
            rows = batch.column(0).drop_null()
            if len(rows):
                x = np.stack([v.values.to_numpy(zero_copy_only=False) for v in rows]).astype(np.float64)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])

    rows = df.select(vec_col).mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    d = 1 + max((r.i for r in rows), default=-1)
    m = np.zeros((d, d))
    for r in rows:
        m[r.i, r.j] = r.s
    return [v.tolist() for v in np.linalg.eigh(m)[1].T[::-1][:k]]


def without_directions(a: Column, directions: list[list[float]]) -> Column:
    out = F.transform(a, lambda x: x.cast("double"))
    for v in directions:
        line = F.array(*[F.lit(x) for x in v])
        out = F.zip_with(out, _scaled(line, dot(out, line)), lambda x, y: x - y)
    return out


def _scaled(line: Column, by: Column) -> Column:
    return F.transform(line, lambda y: y * by)


def hard_negatives(queries: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, label_col: str, k: int) -> DataFrame:
    """(query, id, score, rank): the nearest rows of another label than the query's, near misses, exactly; rows without a label are none."""
    return neighbours(queries, vectors, id_col, vec_col, k, differ=[label_col])


def padded_ngrams(text: Column, sizes: tuple[int, int]) -> Column:
    """Character n-grams of each white-space word padded by blanks, as an array with repeats."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int) -> Column:
        def grams(w: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))

        return F.flatten(F.transform(words, grams))

    return F.flatten(F.array(*[of(n) for n in range(sizes[0], sizes[1] + 1)]))


def ngram_weights(df: DataFrame, id_col: str, text_col: str, sizes: tuple[int, int] = (2, 4)) -> DataFrame:
    """(id, gram, w): tf times smoothed idf, ln((1 + n) / (1 + df)) + 1, each document of length 1."""
    tf = df.select(id_col, F.explode(padded_ngrams(F.col(text_col), sizes)).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("n"))
    idf = tf.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("gram", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, "gram").select(id_col, "gram", (F.col("tf") * F.col("idf")).alias("w"))
    length = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return w.join(length, id_col).select(id_col, "gram", (F.col("w") / F.col("l")).alias("w"))


def cosine_pairs(weights: DataFrame, id_col: str, least: float) -> DataFrame:
    """(a, b, cosine), a < b, at ``least`` or more, exactly, by prefix filtering: grams are put in one global order, rarest
    first; a pair at the threshold shares a gram among those that each document needs to exceed it, so only those are joined."""
    freq = weights.groupBy("gram").agg(F.count("*").alias("f"))
    order = Window.partitionBy(id_col).orderBy("f", "gram")
    rest = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # what follows a position cannot reach the threshold alone once its length is below it
    prefix = weights.join(freq, "gram").withColumn("rest", rest).where(F.sqrt("rest") >= least - 1e-9)
    a = prefix.select("gram", F.col(id_col).alias("a"))
    b = prefix.select("gram", F.col(id_col).alias("b"))
    pairs = a.join(b, "gram").where("a < b").select("a", "b").distinct()
    wa = weights.select(F.col(id_col).alias("a"), "gram", F.col("w").alias("wa"))
    wb = weights.select(F.col(id_col).alias("b"), "gram", F.col("w").alias("wb"))
    met = pairs.join(wa, "a").join(wb, ["b", "gram"])
    return met.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= least)
