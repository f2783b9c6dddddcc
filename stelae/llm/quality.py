"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of width 8 run at stride 4 over the whole text; every chunk of 256 bytes (chunks
overlap by a quarter) keeps each filter's greatest response; the chunks of a document are combined by mean, greatest
and least; a logistic layer over those gives one probability.

The network is fitted on the driver on a bounded sample of labelled rows (``sample_rows``, at most ``sample_bytes`` of
text, chosen by hash of doc_id, so the same at any partitioning); scoring reads every document whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_texts

DIM, FILTERS, STRIDE = 8, 24, 4
CHUNK, HOP = 64, 48  # in strides
SEGMENT = HOP * STRIDE * 1024  # bytes read at once
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8 << 20
THRESHOLD = 0.3


def layout(texts: list[bytes], goes_on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes padded to whole strides, first strides of chunks, their ends, chunks before each document): every byte lies in a chunk.
    A piece that ``goes_on`` ends with the stride that its last window reads ahead; elsewhere that stride is zeros."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ahead = np.ones(len(texts), np.int64) if goes_on is None else 1 - goes_on.astype(np.int64)
    strides = np.maximum((sizes + STRIDE - 1) // STRIDE + ahead, 2)
    at = np.r_[0, np.cumsum(strides)]
    flat = np.zeros(int(at[-1]) * STRIDE, np.uint8)
    for t, k in zip(texts, at[:-1]):
        if t:
            flat[k * STRIDE : k * STRIDE + len(t)] = np.frombuffer(t, np.uint8)
    windows = strides - 1
    chunks = np.maximum((windows - CHUNK + HOP - 1) // HOP, 0) + 1
    before = np.r_[0, np.cumsum(chunks)]
    doc = np.repeat(np.arange(len(texts)), chunks)
    nth = np.arange(before[-1]) - before[doc]
    first = at[doc] + nth * HOP
    end = np.minimum(first + CHUNK, at[doc] + windows[doc])
    return flat, first, end, before


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(f),
            "conv": rng.normal(0, 1 / np.sqrt(2 * STRIDE * DIM), (2 * STRIDE * DIM, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "top": np.zeros(3 * FILTERS, f),
            "shift": np.zeros(1, f),
        }
        self.mean, self.scale = np.zeros(3 * FILTERS, f), np.ones(3 * FILTERS, f)

    def responses(self, flat: np.ndarray) -> np.ndarray:
        """The filters' responses at every stride; a window is a stride and the next, so its two halves are multiplied apart."""
        p, half = self.p, STRIDE * DIM
        e = p["embed"][flat].reshape(-1, half)
        y = e @ p["conv"][:half]
        y[:-1] += (e @ p["conv"][half:])[1:]
        y += p["bias"]
        return y

    def pooled(self, flat, first, end, before) -> tuple[np.ndarray, np.ndarray]:
        y = self.responses(flat)
        cuts = np.stack([first, np.minimum(end, len(y) - 1)], axis=1).ravel()
        top = np.maximum(np.maximum.reduceat(y, cuts, axis=0)[::2], 0)
        return y, top

    def features(self, top: np.ndarray, before: np.ndarray) -> np.ndarray:
        n = np.diff(before)[:, None].astype(np.float32)
        at = before[:-1]
        return np.concatenate([np.add.reduceat(top, at) / n, np.maximum.reduceat(top, at), np.minimum.reduceat(top, at)], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Texts are read in pieces of SEGMENT bytes that overlap as chunks do; a document's chunks are combined over its pieces, so memory is bounded."""
        if not texts:
            return np.empty(0)
        step, over = SEGMENT, (CHUNK - HOP) * STRIDE
        cuts = [(i, at, at + step + over < len(t)) for i, t in enumerate(texts) for at in range(0, max(len(t) - over, 1), step)]
        parts = [(i, texts[i][at : at + step + over + STRIDE * more], more) for i, at, more in cuts]
        n, k = len(texts), FILTERS
        count, total = np.zeros(n), np.zeros((n, k))
        most, least = np.full((n, k), -np.inf, np.float32), np.full((n, k), np.inf, np.float32)
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end][1]) <= 2 * SEGMENT):
                size += len(parts[end][1])
                end += 1
            flat, first, last, before = layout([t for _, t, _ in parts[at:end]], np.array([more for _, _, more in parts[at:end]]))
            top = self.pooled(flat, first, last, before)[1]
            doc, cut = np.array([i for i, _, _ in parts[at:end]]), before[:-1]
            np.add.at(count, doc, np.diff(before))
            np.add.at(total, doc, np.add.reduceat(top, cut))
            np.maximum.at(most, doc, np.maximum.reduceat(top, cut))
            np.minimum.at(least, doc, np.minimum.reduceat(top, cut))
            at = end
        x = (np.concatenate([total / count[:, None], most, least], axis=1) - self.mean) / self.scale
        z = x @ self.p["top"] + self.p["shift"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def _gradients(self, texts, labels):
        p, half = self.p, STRIDE * DIM
        flat, first, end, before = layout(texts)
        y, top = self.pooled(flat, first, end, before)
        f = self.features(top, before)
        x = (f - self.mean) / self.scale
        prob = 1 / (1 + np.exp(-np.clip(x @ p["top"] + p["shift"], -30, 30)))
        g = ((prob - labels) / len(labels)).astype(np.float32)
        out = {"top": x.T @ g + 1e-4 * p["top"], "shift": g.sum(keepdims=True)}
        gf = g[:, None] * p["top"] / self.scale
        n = np.diff(before)
        doc = np.repeat(np.arange(len(n)), n)
        gt = gf[doc, :FILTERS] / n[doc, None]
        gt += gf[doc, FILTERS : 2 * FILTERS] * (top == f[doc, FILTERS : 2 * FILTERS])
        gt += gf[doc, 2 * FILTERS :] * (top == f[doc, 2 * FILTERS :])
        gt *= top > 0
        # the window at which a chunk had its greatest response takes that response's gradient
        span = np.minimum(first[:, None] + np.arange(CHUNK), end[:, None] - 1)
        where = first[:, None] + y[span].argmax(axis=1)
        where = np.minimum(where, end[:, None] - 1)
        row = where.ravel()
        gy = gt.ravel()
        k = np.tile(np.arange(FILTERS), len(first))
        seen = flat.reshape(-1, STRIDE)[np.stack([row, row + 1], axis=1)].reshape(len(row), 2 * STRIDE)
        e = p["embed"][seen].reshape(len(row), 2 * half)
        conv = np.zeros_like(p["conv"])
        embed = np.zeros_like(p["embed"])
        for j in range(FILTERS):
            at = np.flatnonzero((k == j) & (gy != 0))
            conv[:, j] = e[at].T @ gy[at]
            ge = gy[at, None] * p["conv"][:, j]
            cell = (seen[at].reshape(-1, 1).astype(np.int64) * DIM + np.arange(DIM)).ravel()
            embed += np.bincount(cell, weights=ge.ravel(), minlength=256 * DIM).reshape(256, DIM).astype(np.float32)
        out |= {"conv": conv, "embed": embed, "bias": gt.sum(axis=0)}
        eps = 1e-9
        loss = -np.mean(labels * np.log(prob + eps) + (1 - labels) * np.log(1 - prob + eps))
        return out, float(loss)

    def fit(self, texts: list[bytes], labels: np.ndarray, rounds: int = 5, batch: int = 48, rate: float = 0.01, seed: int = 3) -> "Network":
        """Adam on the logistic loss; features are standardised once on the first rows, so that the top layer starts well scaled."""
        rng = np.random.default_rng(seed)
        labels = np.asarray(labels, np.float32)
        if len(texts) == 0 or labels.min() == labels.max():
            share = float(labels.mean()) if len(labels) else 0.5
            self.p["shift"][:] = np.log((share + 0.01) / (1.01 - share))
            return self
        few = texts[:256]
        flat, first, end, before = layout(few)
        f = self.features(self.pooled(flat, first, end, before)[1], before)
        self.mean, self.scale = f.mean(axis=0), np.maximum(f.std(axis=0), 0.1).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, rounds * (-(-len(texts) // batch))
        for _ in range(rounds):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                grads, _ = self._gradients([texts[i] for i in rows], labels[rows])
                step += 1
                lr = rate * (1 - step / (total + 1))
                for key, g in grads.items():
                    m[key] = 0.9 * m[key] + 0.1 * g
                    s[key] = 0.99 * s[key] + 0.01 * g * g
                    self.p[key] -= (lr * (m[key] / (1 - 0.9**step)) / (np.sqrt(s[key] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that are not held out, by hash of doc_id; rows without a label or id are left out."""
    known = labels.select(F.col("doc_id").alias("k"), F.col("quality").cast("int").alias("label")).where("k is not null and label is not null")
    known = known.where(~held_out("k")).groupBy("k").agg(F.max("label").alias("label"))
    few = known.orderBy(F.xxhash64("k"), "k").limit(rows)  # at most `rows` rows of 12 bytes: safe to broadcast
    return docs.select(F.col("doc_id").alias("k"), "text").join(F.broadcast(few), "k").select("k", "text", "label")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Network:
    """Fit on the bounded sample: one text of each id (the least by hash where ids repeat), taken whole in order of hash; one that
    does not fit into what is left of ``most_bytes`` is passed over."""
    found = sample(docs, labels, rows).select("k", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "label").withColumn("x", F.xxhash64("text"))
    one = found.groupBy("k").agg(F.min(F.struct("x", F.octet_length("text").alias("n"))).alias("o"))
    sizes = one.select("k", F.xxhash64("k").alias("h"), "o.x", "o.n").collect()  # at most `rows` rows of numbers
    left, take = most_bytes, []
    for r in sorted(sizes, key=lambda r: (r.h, r.k)):
        if r.n <= left:
            left -= r.n
            take.append(r)
    if not take:
        return Network().fit([], np.empty(0, np.float32))
    chosen = found.where(F.col("k").isin([r.k for r in take]) & F.col("x").isin([r.x for r in take])).dropDuplicates(["k", "x"]).collect()
    of = {(r.k, r.x): r for r in chosen}
    got = [of[r.k, r.x] for r in take]
    return Network().fit([bytes(r.text) for r in got], np.array([r.label for r in got], np.float32))


def scores(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, repeated rows included.

    Null and empty texts are scored as empty; very long texts are scored whole, in memory proportional to the text.
    """

    def rows(ids, texts):
        s = network.score(texts)
        return {"doc_id": ids, "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_texts(docs, rows, f"doc_id {id_type(docs, id_col).simpleString()}, score double, predicted int", id_col, text_col)
