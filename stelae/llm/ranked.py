"""Ranked lexical search by hierarchical max trees.

Queries are taken in blocks of bounded size. One pass over the corpus writes, packed by piece of up to 512 documents, the
places of a block's terms, and counts documents, terms and the documents of each term. A task then joins pieces to shards
of bounded size, its documents in order of id. For each term a tree stands over the shard's range of documents: a leaf is
what the term adds to a document's score, a node the highest leaf below it, with ``FAN`` children; a level's trees are one
sorted array of (term, node), so what a term does not reach takes no room.

A query descends best-first: a node's bound is the sum of its terms' values there, which no document below exceeds; the
nodes of the highest bounds are opened, and those whose bound equals the score to beat as well, as of equal scores the
smaller id wins. What no bound can bring above the score to beat is never opened. The score to beat is carried from shard
to shard of a task; each task says at most ``k`` documents of a query, and these meet by salted ranks.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import id_and_bytes, pieces, stage, unstage
from .decontaminate import _blocks, words_of

K, FAN, BATCH, SALTS = 20, 16, 16, 64
#: Places and documents of a shard.
PLACES, DOCUMENTS = 2 << 20, 1 << 15


class Queries:
    """A block of queries: their terms' numbers, and of each query (its terms, how often each)."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.vocab: dict[bytes, int] = {}
        self.items = []
        for _, text in items:
            found = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)], np.int64)
            self.items.append(np.unique(found, return_counts=True))

    def places(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """(terms of the text with repeats, the queries' terms in it, how often each)."""
        words, get = words_of(text), self.vocab.get
        found = np.array([k for k in map(get, words) if k is not None], np.int64)
        return len(words), *np.unique(found, return_counts=True)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Tree:
    """The max trees of all terms over one shard."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        rank = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[rank] = np.arange(len(ids))
        self.ids = ids[rank]
        m = 100 - 25 + (25 * n * n_docs) // max(n_terms, 1)
        value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        size, key = max(len(ids), 1), term * max(len(ids), 1) + place[doc]
        order = np.argsort(key[value > 0], kind="stable")
        key, value = key[value > 0][order], value[value > 0][order]
        self.levels = [(size, key, value)]
        while size > FAN:
            above = -(-size // FAN)
            term, node = key // size, key % size // FAN
            key, size = term * above + node, above
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            value = np.maximum.reduceat(value, new) if len(new) else value
            key = key[new]
            self.levels.append((size, key, value))

    def bounds(self, level: int, first: np.ndarray, wide: int, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, bound) of the nodes first..first + wide of a level that any term reaches."""
        size, key, value = self.levels[level]
        lo = np.searchsorted(key, (terms[:, None] * size + first).ravel())
        hi = np.searchsorted(key, (terms[:, None] * size + np.minimum(first + wide, size)).ravel())
        many = hi - lo
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        slot = np.repeat(np.tile(np.arange(len(first)), len(terms)), many)
        node = key[at] % size
        total = np.zeros((len(first), wide), np.int64)
        np.add.at(total, (slot, node - first[slot]), value[at] * np.repeat(np.repeat(times, len(first)), many))
        s, k = np.nonzero(total)
        return first[s] + k, total[s, k]

    def search(self, terms: np.ndarray, times: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Put into ``best``, a heap of (score, -id) with the worst first, what this shard has above it; the number of nodes opened."""
        top = len(self.levels) - 1
        span = [FAN**level for level in range(top + 1)]
        node, bound = self.bounds(top, np.zeros(1, np.int64), self.levels[top][0], terms, times)
        frontier = [(-b, top, x) for x, b in zip(node.tolist(), bound.tolist())]
        heapq.heapify(frontier)
        opened = 0

        def beaten(b: int, first: int) -> bool:
            return len(best) == k and (b < best[0][0] or (b == best[0][0] and first >= -best[0][1]))

        while frontier and not (len(best) == k and -frontier[0][0] < best[0][0]):
            by_level: dict[int, list[int]] = {}
            for _ in range(BATCH):
                b, level, x = heapq.heappop(frontier)
                if not beaten(-b, int(self.ids[x * span[level]])):
                    if level:
                        by_level.setdefault(level, []).append(x)
                    else:
                        entry = (-b, -int(self.ids[x]))
                        heapq.heappushpop(best, entry) if len(best) == k else heapq.heappush(best, entry)
                if not frontier:
                    break
            for level, nodes in by_level.items():
                opened += len(nodes)
                node, bound = self.bounds(level - 1, np.array(nodes) * FAN, FAN, terms, times)
                least = best[0][0] if len(best) == k else 0
                for x, b in zip(node.tolist(), bound.tolist()):
                    if b >= least:
                        heapq.heappush(frontier, (-b, level - 1, x))
        return opened


_PLACES = "ids array<bigint>, n array<bigint>, doc binary, term binary, tf binary, n_docs bigint, n_terms bigint, terms array<bigint>, df array<bigint>"


def _placed(sent):
    """Of each piece the places of the block's terms; at a task's end its counts."""

    def work(batches):
        queries = sent.value
        df, n_docs, n_terms = np.zeros(len(queries.vocab), np.int64), 0, 0
        for batch in batches:
            for part in pieces(batch):
                ids, n, doc, term, tf = [], [], [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    length, found, times = queries.places(t)
                    df[found] += 1
                    n_docs, n_terms = n_docs + (length > 0), n_terms + length
                    if len(found) and i is not None:
                        doc.append(np.full(len(found), len(ids), np.int32))
                        term.append(found.astype(np.int32))
                        tf.append(times.astype(np.int32))
                        ids.append(i)
                        n.append(length)
                if ids:
                    yield _row(ids, n, *(np.concatenate(x).tobytes() for x in (doc, term, tf)), None, None, None, None)
        used = np.flatnonzero(df)
        yield _row(None, None, None, None, None, n_docs, n_terms, used.tolist(), df[used].tolist())

    return work


def _row(*values) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}
    names, types = zip(*(f.split(" ") for f in _PLACES.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, t in zip(values, types)], list(names))


def _searched(sent, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    def work(batches):
        queries, best = sent.value, [[] for _ in sent.value.items]
        held, documents, places = [], 0, 0

        def shard():
            at, rows = 0, []
            for ids, n, doc, term, tf in held:
                rows.append((ids, n, doc + at, term, tf))
                at += len(ids)
            tree = Tree(*(np.concatenate(x) for x in zip(*rows)), weight, n_docs, n_terms)
            for (terms, times), found in zip(queries.items, best):
                tree.search(terms, times, found, k)

        for batch in batches:
            for row in zip(*batch.columns):
                ids, n = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in row[:2])
                held.append((ids, n, *(np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in row[2:])))
                documents, places = documents + len(ids), places + len(held[-1][2])
                if places >= PLACES or documents >= DOCUMENTS:
                    shard()
                    held, documents, places = [], 0, 0
        if held:
            shard()
        task = TaskContext.get().partitionId()
        out = [(item, -doc, score) for item, found in enumerate(best) for score, doc in found]
        if out:
            item, doc, score = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, [task] * len(out), doc, score)], ["item", "task", "doc_id", "score"])

    return work


def best_documents(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item, equal ones by id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case; scores are those of the
    formula in :class:`Tree` and :func:`weights`. Null and empty texts have no terms. Document ids are integers; rows with a null
    id count in the statistics and are not ranked; rows that share an id are ranked each. Items with a null id are left out, items
    that share one are answered each; an item without terms has no rows. No documents or no items: no rows. Items are read in
    blocks (``decontaminate.BLOCK_ITEMS``, ``BLOCK_BYTES``), each of which reads the corpus once.
    """
    spark = docs.sparkSession
    texts = id_and_bytes(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col)
    kind = items.schema[item_col].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    done: DataFrame | None = None
    for block in _blocks(items, item_col, item_text):
        queries = Queries(block)
        sent = spark.sparkContext.broadcast(queries)  # bounded by the block's size
        placed = stage(texts.mapInArrow(_placed(sent), _PLACES), "ranked-places")
        said = placed.where("n_docs is not null")
        n_docs, n_terms = said.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = np.zeros(len(queries.vocab), np.int64)
        for r in said.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect():  # the block's terms at most
            df[r.terms] = r.df
        found = placed.where("n_docs is null").select("ids", "n", "doc", "term", "tf").mapInArrow(_searched(sent, weights(df, n_docs), n_docs, n_terms, k), "item bigint, task bigint, doc_id bigint, score bigint")
        order = [F.desc("score"), F.col("doc_id")]
        some = found.withColumn("salt", F.pmod("task", F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
        ranked = stage(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")  # a block's items at most
        unstage(placed)
        done = ranked if done is None else done.unionByName(ranked)
    return spark.createDataFrame([], schema) if done is None else done
