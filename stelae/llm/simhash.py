"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits, majority of the XXH64 values (seed 42) of word shingles.

Links: two fingerprints link at Hamming distance 3 or less. Each half of 32 bits is covered by a code whose words are
the anchors: the [31,26] Hamming code (perfect, covering radius 1) beside one free bit. Of two linked fingerprints one
half differs in at most one bit, so there the covering radius plus the threshold is 2: every fingerprint goes to all
anchors within distance 2 of either half (16.5 on average), and to its own nearest anchor as a resident. A linked pair
therefore meets at the resident's anchor, where residents are compared with all. Anchors with more rows than ``block``
are dealt over pairs of blocks, so no task holds more than 2 * ``block`` rows of one anchor, and each comparison emits
links of a spanning forest rather than all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_texts, stage, unstage
from .components import components

MOST_BITS = 3
BLOCK = 2048


def fingerprint(text: bytes, words_per_shingle: int = 3) -> bytes:
    """Eight bytes, most significant bit first. No words: zero; fewer words than a shingle: the whole sequence is one."""
    words = text.lower().split()  # on bytes both act on ASCII alone
    if not words:
        return bytes(8)
    k, digest = words_per_shingle, xxhash.xxh64_intdigest
    grams = zip(*(words[i:] for i in range(k))) if len(words) > k else [tuple(words)]
    hashes = np.fromiter((digest(b" ".join(g), 42) for g in grams), dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer. Null texts count as empty (fingerprint zero)."""

    def rows(ids, texts):
        packed = b"".join(fingerprint(t, words_per_shingle) for t in texts)
        return {"doc_id": ids, "fp": np.frombuffer(packed, ">i8").astype(np.int64)}

    return map_texts(docs, rows, f"doc_id {id_type(docs, id_col).simpleString()}, fp bigint", id_col, text_col)


def _syndrome(bits: np.ndarray) -> np.ndarray:
    """Of 31-bit words, bit p - 1 standing for position p: the exclusive or of the positions that are set."""
    out = np.zeros(len(bits), np.int64)
    for j in range(5):
        mask = np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1))
        out |= (np.bitwise_count(bits & mask).astype(np.int64) & 1) << j
    return out


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 32-bit values: (row, anchor, resident) of every anchor within distance 2."""
    half = half.astype(np.uint32)
    low, free = half & np.uint32(0x7FFFFFFF), half & np.uint32(0x80000000)
    s = _syndrome(low)
    flip = np.where(s > 0, np.left_shift(np.uint32(1), np.maximum(s - 1, 0).astype(np.uint32)), np.uint32(0)).astype(np.uint32)
    near, rows = low ^ flip, np.arange(len(half))
    out = [(rows, near | free, np.ones(len(rows), bool)), (rows, near | (free ^ np.uint32(0x80000000)), np.zeros(len(rows), bool))]
    for i in range(1, 32):
        j = i ^ s
        at = np.flatnonzero((s > 0) & (j > i))
        two = np.uint32(1 << (i - 1)) | np.left_shift(np.uint32(1), (j[at] - 1).astype(np.uint32))
        out.append((at, (low[at] ^ two) | free[at], np.zeros(len(at), bool)))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _replicate(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            fp = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False)
            wide = fp.view(np.uint64)
            for k in (0, 1):
                row, anchor, resident = anchors_of((wide >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int64) | (k << 32)), pa.array(fp[row]), pa.array(resident)], ["anchor", "fp", "resident"]
                )


def _spanning(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the values within ``most`` bits of each other."""
    out, rest = [], np.unique(fps).view(np.uint64)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= most
            if near.any():
                found, rest = rest[near], rest[~near]
                out += zip([int(at.astype(np.int64))] * len(found), found.view(np.int64).tolist())
                queue += list(found)
    return out


def _compare(most: int):
    """Links within each run of equal keys of a sorted stream (k1, k2, k3, fp). A run holds at most two blocks of an anchor."""

    def links(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        out = []
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(fps)])
        for a, n in zip(starts[sizes > 6], sizes[sizes > 6]):
            out += _spanning(fps[a : a + n], most)
        small = np.repeat(sizes <= 6, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        for d in range(1, 6):
            i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d])) if len(fps) > d else np.empty(0, int)
            i = i[(np.bitwise_count((fps[i] ^ fps[i + d]).view(np.uint64)) <= most) & (fps[i] != fps[i + d])]
            out += zip(fps[i].tolist(), fps[i + d].tolist())
        return out

    def work(batches):
        held_k, held_f = np.empty((0, 3), np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            held_k = np.concatenate([held_k, k])
            held_f = np.concatenate([held_f, batch.column(3).to_numpy(zero_copy_only=False)])
            last = np.flatnonzero((held_k != held_k[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                found = links(held_k[:cut], held_f[:cut])
                held_k, held_f = held_k[cut:], held_f[cut:]
                yield _pairs(found)
        if len(held_f):
            yield _pairs(links(held_k, held_f))

    return work


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = (np.array(x, np.int64) for x in (zip(*found) if found else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(nodes: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """From distinct fingerprints (fp), links (u, v) whose components are those of all pairs within ``most`` bits."""
    if most > 3:
        raise ValueError("anchors within distance 2 of either half find pairs of up to 3 differing bits")
    met = nodes.select("fp").mapInArrow(_replicate, "anchor bigint, fp bigint, resident boolean")
    busy = met.groupBy("anchor").agg(F.count("*").alias("n"), F.max("resident").alias("any")).where("n > 1 and any")
    busy = busy.select("anchor", F.ceil(F.col("n") / block).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    every = F.sequence(F.lit(0), F.col("k") - 1)
    here = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    as_guest = F.transform(every, lambda i: F.struct(i.alias("a"), own.alias("b")))
    as_resident = F.transform(every, lambda i: F.struct(own.alias("a"), i.alias("b")))
    places = F.when(F.col("k") == 1, F.array(here)).when(F.col("resident"), F.array_distinct(F.concat(as_guest, as_resident))).otherwise(as_guest)
    # by sorting, as Spark knows the size of ``met`` before the 33 rows that a fingerprint becomes, and would send ``busy`` whole
    dealt = met.join(busy.hint("merge"), "anchor").select("anchor", "fp", F.explode(places).alias("p"))
    dealt = dealt.select("anchor", F.col("p.a").alias("a"), F.col("p.b").alias("b"), "fp")
    dealt = dealt.repartition("anchor", "a", "b").sortWithinPartitions("anchor", "a", "b")
    return dealt.mapInArrow(_compare(most), "u bigint, v bigint")


def component_of(marked: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """From rows with ``fp``: (fp, root), each fingerprint once; equal roots are one component."""
    nodes = stage(marked.select("fp").distinct(), "simhash-nodes")
    roots = components(links(nodes, most))
    return nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, most: int = MOST_BITS) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, fp, component_id), the least doc_id reachable over links.

    Null and empty texts share the fingerprint zero and link like any other; equal fingerprints collapse to one node
    before any comparison, so exact copies cost nothing; an empty table gives no rows; a null doc_id is kept in its
    row and never chosen as component_id unless it stands alone (then null).
    """
    marked = stage(fingerprints(docs, id_col, text_col, words_per_shingle), "simhash")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes, most))
    of = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(of.join(least.hint("merge"), "root").select("fp", "component_id"), "simhash-components")
    unstage(roots)
    unstage(nodes)
    return marked.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")
