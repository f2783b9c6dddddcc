"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are read in blocks of bounded size. For each block a first pass over the corpus counts the items' words; an
n-gram of an item is a rare seed if, with its words drawn apart, its share of all places is at most ``chance``, whatever
the corpus's size. (Words are counted, not n-grams, so a passage copied into a third of all documents is as rare as
before.) Of every ``EVERY`` n-grams in a row that have no rare one, the rarest is a seed, so that edits to one part of an
item leave seeds in the others. A second pass joins every document to the items of whose seeds it has one, and aligns the
words around each seed with the item. The score is the best local alignment (match 1, mismatch and gap -1) over the
item's number of words; items of more than ``PART`` words are aligned in parts, whose scores are added.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_bytes, id_type, pieces

SEED, CHANCE, THRESHOLD = 3, 1e-8, 0.5
EVERY, PART = 8, 256
#: A block of test items: so many items and bytes of text at most (one longer item is a block of its own).
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)  # lower case; ASCII marks part words


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment, in words of ``doc``, end exclusive: match 1, mismatch and gap -1.

    By rows of the item; a gap along the row is a running maximum. Starts travel with the scores. Of equal scores the earliest end wins.
    """
    n = len(doc)
    j = np.arange(n + 1)
    h = np.zeros(n + 1, np.int64)
    s = j.copy()
    best = (0, 0, 0)
    for w in item:
        diag = np.zeros(n + 1, np.int64)
        diag[1:] = h[:-1] + np.where(doc == w, 1, -1)
        up = h - 1
        t = np.maximum(np.maximum(diag, up), 0)
        ts = j.copy()
        ts = np.where((t == up) & (t > 0), s, ts)
        ts[1:] = np.where((t[1:] == diag[1:]) & (t[1:] > 0), s[:-1], ts[1:])
        key = (t + j) * (n + 2) + (n + 1 - j)  # the greatest t + j, of equals the first
        run = np.maximum.accumulate(key)
        src = n + 1 - run % (n + 2)
        h_new = t[src] + src - j
        s = np.where(h_new > t, ts[src], ts)
        h = np.maximum(t, h_new)
        k = int(h.argmax())
        if h[k] > best[0]:
            best = (int(h[k]), int(s[k]), k)
    return best


class Index:
    """A block of test items: its vocabulary, its items' parts as word numbers, and the places of their n-grams."""

    def __init__(self, items: list[tuple[int, bytes]], n: int = SEED):
        self.n, self.vocab, self.items, self.parts = n, {}, [], []
        for item, text in items:
            w = words_of(text)
            if w:
                found = np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64)
                cuts = np.linspace(0, len(w), -(-len(w) // PART) + 1).astype(int)
                self.parts += [(len(self.items), found[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                self.items.append((item, len(w)))
        self.size = len(self.vocab)
        self.fit(None, 0)

    def _mix(self, a: np.ndarray, n: int) -> np.ndarray:
        """A 64-bit number for each run of n words; runs that differ but share one are parted by the alignment."""
        out = np.zeros(max(len(a) - n + 1, 0), np.uint64)
        for k in range(n):
            out = (out ^ (a[k : len(a) - n + 1 + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def fit(self, counts: np.ndarray | None, total: int, chance: float = CHANCE) -> None:
        """Choose seeds: the rare n-grams, and the rarest of any EVERY in a row without one, so that no part is left without seeds."""
        logs = np.zeros(self.size) if counts is None else np.log(np.maximum(counts, 1) / max(total, 1))
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, w) in enumerate(self.parts):
            n = min(self.n, len(w))
            keys = self._mix(w, n)
            share = logs[np.lib.stride_tricks.sliding_window_view(w, n)].sum(axis=1)
            use, last = share <= np.log(chance), -1
            for i in range(len(use)):
                if use[i]:
                    last = i
                elif i - last >= EVERY or (i == len(use) - 1 and last < 0):
                    last += 1 + int(share[last + 1 : i + 1].argmin())
                    use[last] = True
            for i in np.flatnonzero(use):
                self.places[n][int(keys[i])].append((k, int(i)))
        self.places = {n: dict(x) for n, x in self.places.items()}
        self.sorted = {n: np.sort(np.array(list(x), np.uint64)) for n, x in self.places.items()}

    def numbers(self, text: bytes) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words_of(text)], np.int64)

    def search(self, text: bytes, threshold: float) -> list[tuple[int, float, int, int, int]]:
        """(item, score, start, end, seeds) of items that align at ``threshold`` or more, the best place of each."""
        a = self.numbers(text)
        hits: dict[int, set[int]] = defaultdict(set)
        seeds: dict[int, int] = defaultdict(int)
        for n, keys in self.sorted.items():
            if len(a) < n:
                continue
            known = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(a >= 0, n).all(axis=1))
            if not len(known):
                continue
            mixed = self._mix(a, n)[known]
            at = np.minimum(np.searchsorted(keys, mixed), len(keys) - 1)
            found = keys[at] == mixed
            for i, key in zip(known[found].tolist(), mixed[found].tolist()):
                for k, off in self.places[n][key]:
                    hits[k].add(i - off)
                    seeds[k] += 1
        of_item: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for k, starts in hits.items():
            w = self.parts[k][1]
            m, best = len(w), (0, 0, 0)
            slack = m // 2 + self.n
            windows: list[list[int]] = []
            ordered = sorted(starts)
            own, times = np.unique(w, return_counts=True)
            for s in ordered:  # windows around the diagonals, joined where they overlap
                lo, hi = max(0, s - slack), min(len(a), s + m + slack)
                if windows and lo <= windows[-1][1] and windows[-1][1] - windows[-1][0] < 8 * m:
                    windows[-1][1] = hi
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                place = np.minimum(np.searchsorted(own, a[lo:hi]), len(own) - 1)
                there = np.bincount(place[own[place] == a[lo:hi]], minlength=len(own))
                if np.minimum(there, times).sum() <= best[0]:
                    continue  # no more words can match than are shared, each as often as both have it
                within = ordered[bisect_left(ordered, lo) : bisect_right(ordered, hi - m)]
                exact = next((s for s in within if np.array_equal(a[s : s + m], w)), None)
                got = (m, exact - lo, exact - lo + m) if exact is not None else align(w, a[lo:hi])
                if got[0] > best[0]:
                    best = (got[0], lo + got[1], lo + got[2])
                if best[0] == m:
                    break
            if best[0]:
                of_item[self.parts[k][0]].append((*best, seeds[k]))
        out = []
        for k, found in of_item.items():
            (item, m), (score, start, end, n) = self.items[k], zip(*found)
            if sum(score) >= threshold * m:
                out.append((item, sum(score) / m, min(start), max(end), sum(n)))
        return out


def _blocks(items: DataFrame, item_col: str, text_col: str):
    """Test items in blocks, read one partition at a time."""
    rows = items.select(F.col(item_col).alias("i"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t")).where("i is not null")
    block, size = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        t = bytes(r.t)
        if block and (len(block) >= BLOCK_ITEMS or size + len(t) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((r.i, t))
        size += len(t)
    if block:
        yield block


def _word_counts(texts: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """How often each of the block's words occurs in the corpus, and the corpus's words in all: a sum for each word and task."""

    def count(batches):
        sums, total = np.zeros(index.size, np.int64), 0
        for batch in batches:
            for part in pieces(batch):
                for t in part.column(1).to_pylist():
                    a = index.numbers(t)
                    total += len(a)
                    sums += np.bincount(a[a >= 0], minlength=index.size)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1].astype(np.int64)), pa.array(np.r_[sums[used], total].astype(np.int64))], ["w", "n"])

    made = texts.mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()  # at most the block's words
    counts = np.zeros(index.size, np.int64)
    total = 0
    for r in made:
        if r.w < 0:
            total = r.n
        else:
            counts[r.w] = r.n
    return counts, total


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    seed: int = SEED,
    chance: float = CHANCE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, n_seeds): every document and item that align at ``threshold`` or more.

    Words are runs of letters and digits in lower case (ASCII marks part them). Null and empty texts and items match
    nothing; an item shorter than a seed is its own seed; repeated documents and items match each. No test items: no
    rows. A document's rows depend on it alone, so copies of one passage in many documents gather nowhere.
    """
    spark = docs.sparkSession
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type(docs, id_col)),
            T.StructField("item_id", items.schema[item_col].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("start_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
            T.StructField("n_seeds", T.LongType()),
        ]
    )
    texts = id_and_bytes(docs, id_col, text_col)
    found: DataFrame | None = None
    for block in _blocks(items, item_col, item_text):
        index = Index(block, seed)
        index.fit(*_word_counts(texts, index), chance)
        sent = spark.sparkContext.broadcast(index)  # bounded by BLOCK_BYTES

        def search(batches, sent=sent):
            for batch in batches:
                for part in pieces(batch):
                    out = [(i, *m) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for m in sent.value.search(t, threshold)]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        part = texts.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found
