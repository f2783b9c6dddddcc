"""Exact substring dedup by suffix arrays.

A byte goes if it lies in a string of ``SPAN`` bytes that also starts in a document with a smaller id. Such strings are
windows; each is ruled by one anchor, the gram of ``GRAM`` bytes within it whose hash is least, so equal windows have equal
anchors at equal places, wherever they stand, and only windows with an anchor that two texts hold need a closer look.

1. Whole texts are packed into shards of a few megabytes, written once, bucketed by shard, so that what later steps say of
   a shard comes to it without a shuffle of texts.
2. Each shard sends its anchors' hashes, in sorted runs, to ranges of hashes; what occurs twice is a candidate. Beside a hash
   stand eight bits of what the anchor rules: one with ``HOT`` different values is hot, as it rules many different stretches.
3. The stretches ruled by candidates (up to ``2 * SPAN - GRAM`` bytes, each different one of a shard once, with its least
   document) are dealt by anchor; those of hot anchors window by window, by the window's own hash.
4. A task cuts what it gets into shards of bounded size and builds the suffix array of each (Larsson-Sadakane refinement:
   sort by 8 bytes, then by pairs of ranks at doubled distance, only where ranks are still shared), the common prefixes
   (Kasai, over the text's order, all places of one step at a time) and the classes of windows that share ``SPAN`` bytes;
   the shards' sorted classes are merged by binary search, and the least document of each class goes back to the shards.
5. Each shard marks the bytes of windows whose class has a smaller document.

No step gathers a class: a shard says each thing once, and a range is cut by size. Ids are integers.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, shared_dir, stage, unstage

SPAN, GRAM = 50, 24
#: Bytes of text in a shard, of text for each range of anchors, and of stretches in a suffix array; different marks (of 256) that make an anchor hot.
SHARD, RANGE, CHUNK, HOT = 4 << 20, 1 << 20, 3 << 20, 128
#: Of an anchor's number the lowest bits: a flag, and a mark of eight bits above it.
_BITS = np.uint64(9)
_BLOCK = 1 << 16
_WIDEST = 2 * SPAN - GRAM


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _strings(flat: np.ndarray, size: int, kind: str) -> np.ndarray:
    """A view of the ``size`` bytes from each place on as one value; zeros follow the end."""
    return np.ndarray(len(flat), kind, np.concatenate([flat, np.zeros(size, np.uint8)]), strides=(1,))


def _eights(flat: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    return _strings(flat, 8, ">u8" if big else "<u8").astype(np.uint64)


_ODD = _mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def _hashes(u: np.ndarray, size: int, at: np.ndarray | int) -> np.ndarray:
    """A hash of the ``size`` bytes from each of the places ``at`` (or the first so many), from their eights. It deals and chooses; bytes decide."""
    u = u ^ (u >> np.uint64(32))  # the highest bytes count in low bits as well
    h = None
    for m, k in zip(_ODD, [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]):
        part = (u[k : k + at] if isinstance(at, int) else u[at + k]) * m
        h = part if h is None else np.add(h, part, out=h)
    return _mix(h)


def ruled(flat: np.ndarray, ends: np.ndarray, block: int = _BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor's hash, mark of the stretch) of the runs of windows that one anchor rules; texts end at ``ends`` and no window crosses an end."""
    wide = SPAN - GRAM + 1
    edge = np.zeros(len(flat) + 1, np.int32)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    some = ends - starts >= SPAN
    np.add.at(edge, starts[some], 1)
    np.add.at(edge, ends[some] - SPAN + 1, -1)
    out, block = [], min(block, (1 << 16) - wide + 1)
    place = np.arange(block + wide - 1, dtype=np.uint32)
    for s in range(0, len(flat) - SPAN + 1, block):
        e = min(s + block, len(flat) - SPAN + 1)
        h = _hashes(_eights(flat[s : e + SPAN]), GRAM, e - s + wide - 1)
        m = (h >> np.uint64(32)).astype(np.uint32)  # 16 bits of the hash, then the place: of equals the first in the window, wherever that stands
        m &= np.uint32(0xFFFF_0000)
        m |= place[: len(m)]
        size = 1
        while size * 2 <= wide:
            m, size = np.minimum(m[:-size], m[size:]), size * 2
        if wide > size:
            m = np.minimum(m[: size - wide], m[wide - size :])
        open_ = np.zeros(e - s + 2, bool)  # closed before and after
        np.greater(np.cumsum(edge[s:e]), 0, out=open_[1:-1])
        if e < len(flat):
            edge[e] += edge[s:e].sum()
        cut = m[1:] != m[:-1]  # another place
        new = np.flatnonzero(open_[1:-1] & (np.concatenate([[True], cut]) | ~open_[:-2]))
        last = np.flatnonzero(open_[1:-1] & (np.concatenate([cut, [True]]) | ~open_[2:]))
        if not len(new):
            continue
        a = (m[new] & np.uint32(0xFFFF)).astype(np.int64)
        mark = _mix(h[new] + np.uint64(3) * h[last + wide - 1] + (last - new).astype(np.uint64)) & np.uint64(255)
        out.append((new + s, last + s, _mix(h[a] + np.uint64(1)), mark))  # mixed anew, as the least of many are small
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_array(flat: np.ndarray) -> np.ndarray:
    """Places of ``flat`` in the order of their suffixes (Larsson-Sadakane): ranks by eight bytes, then by the ranks at doubled
    distance, only of places that still share theirs. A suffix that ends comes before those that go on."""
    n = len(flat)
    key = _eights(flat, big=True)
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.empty(0, bool)
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    at = np.flatnonzero(~new | ~np.concatenate([new[1:], [True]])[:n])  # places in ``sa`` whose rank is shared
    while len(at):
        of = sa[at]
        ahead = np.where(of + h < n, rank[np.minimum(of + h, n)], n - of - h - 1)  # of two that end, the shorter comes first
        pair = rank[of] * (4 * n) + ahead + 2 * n
        order = np.argsort(pair)
        of, pair = of[order], pair[order]
        sa[at] = of
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[of] = first
        at = at[~new | ~np.concatenate([new[1:], [True]])]
        h *= 2
    return sa


def common_prefixes(flat: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place in ``sa``, the bytes that its suffix shares with the one before, ``most`` at most (Kasai): a suffix shares at
    least one byte less than the one that begins a byte earlier, so places are taken in steps, and each goes on from its neighbour."""
    n = len(flat)
    before, shared = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    before[sa[1:]] = sa[:-1]
    eights = _eights(np.concatenate([flat, np.zeros(most + 8, np.uint8)]))
    step = 32
    todo = [np.arange(0, n, step)]
    while step > 1:
        todo.append(np.arange(step // 2, n, step))
        step //= 2
    for k, at in enumerate(todo):
        if k:
            shared[at] = np.maximum(shared[at - (32 >> k)] - (32 >> k), 0)
        at = at[before[at] >= 0]
        limit = np.minimum(n - np.maximum(at, before[at]), most)
        while len(at):
            length = shared[at]
            differ = eights[at + length] ^ eights[before[at] + length]
            same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3  # whole bytes below the first bit that differs, all eight if none does
            shared[at] = length = np.minimum(length + same, limit)
            on = (differ == 0) & (length < limit)
            at, limit = at[on], limit[on]
    out = np.zeros(n, np.int64)
    out[1:] = shared[sa[1:]]
    return out


def _wide(flat: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Fixed-length strings of ``size`` bytes from ``at`` on, comparable as bytes: one that is not zero closes each."""
    out = np.full((len(at), size + 1), 1, np.uint8)
    out[:, :size] = _strings(flat, size, f"V{size}")[at].view(np.uint8).reshape(-1, size)
    return out.view(f"S{size + 1}").ravel()


def classes(flat: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard of stretches: (place of a window of each class in sorted order, its least document, the class of each window).
    Windows come in the order of stretches and places."""
    sa = suffix_array(flat)
    cut = np.cumsum(common_prefixes(flat, sa, SPAN) < SPAN)  # suffixes between two cuts share SPAN bytes or more
    ends = np.cumsum(sizes)
    count = sizes - SPAN + 1
    window = np.repeat(ends - sizes, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    number = np.full(len(flat), -1, np.int64)
    number[window] = np.arange(len(window))
    in_order = number[sa]
    real = in_order >= 0
    in_order, cut = in_order[real], cut[real]
    new = np.concatenate([[True], cut[1:] != cut[:-1]])
    of = np.empty(len(window), np.int64)
    of[in_order] = np.cumsum(new) - 1
    doc = np.repeat(least, count)[in_order]
    return window[in_order[new]], np.minimum.reduceat(doc, np.flatnonzero(new)), of


def least_documents(flat: np.ndarray, sizes: np.ndarray, least: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """For each window of the stretches, the least document of all that hold it: shards of ``chunk`` bytes, merged by binary search."""
    if not len(sizes):
        return np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    cuts, parts, at = [0], [], 0
    while cuts[-1] < len(sizes):
        at = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, at + chunk, "right"))))
    known, owner = None, None
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = flat[ends[a] - sizes[a] : ends[b - 1]]
        window, doc, of = classes(part, sizes[a:b], least[a:b])
        if len(cuts) == 2:
            return doc[of]
        strings = _wide(part, window, SPAN)
        parts.append((strings, of))
        if known is None:
            known, owner = strings, doc
            continue
        place = np.minimum(np.searchsorted(known, strings), len(known) - 1)
        same = known[place] == strings
        owner = owner.copy()
        owner[place[same]] = np.minimum(owner[place[same]], doc[same])
        into = np.searchsorted(known, strings[~same])
        known, owner = np.insert(known, into, strings[~same]), np.insert(owner, into, doc[~same])
    return np.concatenate([owner[np.searchsorted(known, strings)][of] for strings, of in parts])


# --- shards of whole texts

_SHARD = "shard bigint, size bigint, ids array<bigint>, ends array<bigint>, text binary"


def _packed(batches, most: int):
    """Whole texts in shards of about ``most`` bytes; a shard's number is that of the task and its own."""
    part, made = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def shard():
        ends = np.cumsum([len(t) for t in texts])
        columns = [[(part << 32) + made], [size], [ids], [ends], [b"".join(texts)]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "size", "ids", "ends", "text"])

    for batch in batches:
        for rows in pieces(batch):
            for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= most or len(ids) >= 1 << 16:
                    yield shard()
                    ids, texts, size, made = [], [], 0, made + 1
    if ids:
        yield shard()


class _Bucketed:
    """The shards, as a table in the shared folder that is bucketed by shard, and that goes when it is no longer needed."""

    def __init__(self, shards: DataFrame, buckets: int):
        self.spark, self.name = shards.sparkSession, f"stelae_shards_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{self.name}"
        shards.write.bucketBy(buckets, "shard").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(self.name)
        self.df = self.spark.table(self.name)
        self.df._stage_path = path

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        unstage(self.df)


def _arrays(batch: pa.RecordBatch, row: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shard, ids, whether each id is known, ends, text) of a row of shards."""
    ids = batch.column(1)[row].values
    known = np.asarray(ids.is_valid())
    return (
        batch.column(0)[row].as_py(),
        ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
        known,
        batch.column(2)[row].values.to_numpy(zero_copy_only=False).astype(np.int64),
        np.frombuffer(batch.column(3)[row].as_buffer(), np.uint8),
    )


def _by_range(batches):
    """Rows in order of their first column, gathered: (range, the other columns as lists)."""
    now, held = None, []
    for batch in batches:
        for r, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if r != now and held:
                yield now, list(zip(*held))
                held = []
            now = r
            held.append(row)
    if held:
        yield now, list(zip(*held))


def _numbers(blobs, kind) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in blobs]


_KEYS = "r bigint, shard bigint, keys binary"


def _anchors(ranges: int):
    """Each shard's anchors with their marks, once each, by range; the lowest bit says that two of its documents hold one."""

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard, ids, known, ends, flat = _arrays(batch, row)
                first, _, key, mark = ruled(flat, ends)
                doc = np.searchsorted(ends, first, "right")
                use = known[doc]
                key, doc = key[use] >> _BITS << _BITS | mark[use] << np.uint64(1), ids[doc[use]]
                order = np.argsort(key)
                key, doc = key[order], doc[order]
                if not len(key):
                    continue
                anchor = np.concatenate([[True], key[1:] >> _BITS != key[:-1] >> _BITS])
                begin = np.flatnonzero(anchor)
                many = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
                new = np.concatenate([[True], key[1:] != key[:-1]])
                sent = key[new] | many[np.cumsum(anchor)[new] - 1].astype(np.uint64)
                yield _dealt(sent, _range(sent, ranges), shard)

    return work


def _range(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> np.uint64(32)).astype(object) * ranges >> 32).astype(np.int64) if ranges >= 1 << 31 else ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _cuts(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the runs of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    return cut, np.concatenate([cut[1:], [len(r)]])


def _dealt(sent: np.ndarray, r: np.ndarray, shard: int) -> pa.RecordBatch:
    a, b = _cuts(r)
    return pa.RecordBatch.from_arrays(
        [pa.array(r[a]), pa.array(np.full(len(a), shard, np.int64)), pa.array([sent[i:j].tobytes() for i, j in zip(a, b)], pa.binary())], ["r", "shard", "keys"]
    )


def _shared(hot: int):
    """Of each shard's anchors those that two documents hold; the lowest bit now says that one is hot."""

    def work(batches):
        for _, (shards, blobs) in _by_range(batches):
            runs = _numbers(blobs, np.uint64)
            sent = np.concatenate(runs)
            order = np.argsort(sent)
            ordered = sent[order]
            begin = np.flatnonzero(np.concatenate([[True], ordered[1:] >> _BITS != ordered[:-1] >> _BITS]))
            count = np.diff(np.concatenate([begin, [len(sent)]]))
            other = np.concatenate([[True], ordered[1:] >> np.uint64(1) != ordered[:-1] >> np.uint64(1)])
            marks = np.add.reduceat(other.astype(np.int64), begin)
            keep = (count > 1) | (ordered[begin] & np.uint64(1) > 0)
            group = np.empty(len(sent), np.int64)
            group[order] = np.repeat(np.arange(len(begin)), count)
            at, out = 0, []
            for shard, run in zip(shards, runs):
                mine = group[at : at + len(run)]
                said = run >> _BITS << _BITS | (marks[mine] >= hot).astype(np.uint64)
                said = said[keep[mine] & np.concatenate([[True], run[1:] >> _BITS != run[:-1] >> _BITS])]
                at += len(run)
                if len(said):
                    out.append((shard, said.tobytes()))
            if out:
                yield _rows(out, "shard bigint, keys binary")

    return work


class _Stretches:
    """What a shard's candidates rule. ``place``, ``doc`` and ``unique`` (its number among the different ones) of every stretch; of the
    different ones ``least`` and ``many`` (their documents). What is sent are parts of the different ones, all of one or, where the
    anchor is hot, each window, in order of range: ``r``, ``of`` (the stretch), ``begin`` (the first window), ``size`` and ``at`` (a place)."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, ends: np.ndarray, flat: np.ndarray, blobs: list[bytes], ranges: int):
        first, last, key, _ = ruled(flat, ends)
        said = np.sort(np.concatenate(_numbers(blobs, np.uint64)))
        doc = np.searchsorted(ends, first, "right")
        at = np.minimum(np.searchsorted(said >> _BITS, key >> _BITS), len(said) - 1)
        use = (said[at] >> _BITS == key >> _BITS) & known[doc]
        self.place, self.doc, size, key = first[use], ids[doc[use]], (last - first)[use] + SPAN, said[at[use]]
        self.unique, rep, self.least, self.many = _different(_padded(flat, self.place, size), self.doc)
        hot = key[rep] & np.uint64(1) > 0
        count = np.where(hot, size[rep] - SPAN + 1, 1)
        of = np.repeat(np.arange(len(rep)), count)
        begin = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at = self.place[rep][of] + begin
        dealt = key[rep][of] & ~np.uint64(1)
        dealt[hot[of]] = _window_hashes(flat, at[hot[of]])
        r = _range(dealt, ranges)
        order = np.argsort(r, kind="stable")
        self.r, self.of, self.begin, self.at = r[order], of[order], begin[order], at[order]
        self.size = np.where(hot[self.of], SPAN, size[rep][self.of])


def _padded(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches as strings of one length, comparable as bytes; the last byte, not zero, is their size."""
    text = _strings(flat, _WIDEST + 1, f"V{_WIDEST + 1}")[at].view(np.uint8).reshape(-1, _WIDEST + 1)
    text[:, SPAN:] *= np.arange(SPAN, _WIDEST + 1) < size[:, None]
    text[:, _WIDEST] = size
    return text.view(f"S{_WIDEST + 1}").ravel()


def _different(strings: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each among the different ones, one place of each of these, its least document, whether it has several)."""
    order = np.lexsort((doc, strings))
    s, d = strings[order], doc[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    number = np.cumsum(new) - 1
    unique = np.empty(len(s), np.int64)
    unique[order] = number
    many = np.zeros(int(new.sum()), bool)
    many[number[d != d[new][number]]] = True
    return unique, order[new], d[new], many


def _window_hashes(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the window at each place, by blocks of the text (``at`` ascends within a stretch, not throughout)."""
    out = np.empty(len(at), np.uint64)
    order = np.argsort(at, kind="stable")
    sorted_ = at[order]
    for s in range(0, len(flat), _BLOCK):
        a, b = np.searchsorted(sorted_, [s, s + _BLOCK])
        if b > a:
            u = _eights(flat[s : s + _BLOCK + SPAN])
            out[order[a:b]] = _hashes(u, SPAN, sorted_[a:b] - s)
    return out


_STRETCHES = "r bigint, shard bigint, number bigint, sizes binary, least binary, many binary, bytes binary"


def _stretches(ranges: int):
    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard, ids, known, ends, flat = _arrays(batch, row)
                x = _Stretches(ids, known, ends, flat, batch.column(4)[row].as_py(), ranges)
                if not len(x.r):
                    continue
                a, b = _cuts(x.r)
                out = []
                for i, j in zip(a.tolist(), b.tolist()):
                    size, of = x.size[i:j], x.of[i:j]
                    text = flat[np.repeat(x.at[i:j] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    out.append((int(x.r[i]), shard, i, size.astype(np.uint8).tobytes(), x.least[of].tobytes(), x.many[of].tobytes(), text.tobytes()))
                    if len(out) >= 1024:
                        yield _rows(out, _STRETCHES)
                        out = []
                if out:
                    yield _rows(out, _STRETCHES)

    return work


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


_OWNERS = "shard bigint, said binary"


def _owners(batches, chunk: int):
    """To each shard, of the stretches it sent: (number, first window, windows, least document) of the runs that may remove something."""
    for _, (shards, numbers, sizes, least, many, texts) in _by_range(batches):
        size_of = _numbers(sizes, np.uint8)
        size = np.concatenate(size_of).astype(np.int64)
        own, several = np.concatenate(_numbers(least, np.int64)), np.concatenate(_numbers(many, bool))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        place = np.cumsum(size) - size
        unique, rep, first, _ = _different(_padded(flat, place, size), own)  # equal ones of several shards are one
        width = size[rep]
        owner = least_documents(flat[np.repeat(place[rep] - np.cumsum(width) + width, width) + np.arange(width.sum())], width, first, chunk)
        count = width - SPAN + 1
        of = np.repeat(np.arange(len(rep)), count)
        a = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (owner[1:] != owner[:-1])]))
        begin, length, to = a - (np.cumsum(count) - count)[of[a]], np.diff(np.concatenate([a, [len(of)]])), owner[a]
        lo, hi = np.searchsorted(of[a], unique, "left"), np.searchsorted(of[a], unique, "right")
        i = np.repeat(np.arange(len(size)), hi - lo)
        k = np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo) + np.arange((hi - lo).sum())
        runs = np.stack([i, begin[k], length[k], to[k]], axis=1)[(to[k] < own[i]) | several[i]]
        at, out = 0, []
        for shard, number, n in zip(shards, numbers, map(len, size_of)):
            i, j = np.searchsorted(runs[:, 0], [at, at + n])
            if j > i:
                mine = runs[i:j].copy()
                mine[:, 0] += number - at
                out.append((shard, mine.tobytes()))
            at += n
        if out:
            yield _rows(out, _OWNERS)


_KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"


def _removed(ranges: int, with_text: bool):
    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                _, ids, known, ends, flat = _arrays(batch, row)
                keys, said = batch.column(4)[row].as_py(), batch.column(5)[row].as_py()
                edge = np.zeros(len(flat) + 1, np.int32)
                if said:
                    x = _Stretches(ids, known, ends, flat, keys, ranges)
                    runs = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 4) for b in said])
                    runs[:, 0], runs[:, 1] = x.of[runs[:, 0]], runs[:, 1] + x.begin[runs[:, 0]]
                    runs = runs[np.argsort(runs[:, 0], kind="stable")]
                    lo, hi = np.searchsorted(runs[:, 0], x.unique, "left"), np.searchsorted(runs[:, 0], x.unique, "right")
                    many = hi - lo
                    at = np.repeat(np.arange(len(many)), many)
                    run = runs[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    gone = run[:, 3] < x.doc[at]
                    start = (x.place[at] + run[:, 1])[gone]
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + run[gone, 2] + SPAN - 1, -1)
                mask = np.cumsum(edge[:-1]) > 0
                rows, a = [], 0
                for i, e, there in zip(ids.tolist(), ends.tolist(), known.tolist()):
                    text, out = flat[a:e], mask[a:e]
                    gone = int(out.sum())
                    kept = (text[~out] if gone else text).tobytes()
                    spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()) if gone else 0
                    rows.append((i if there else None, e - a, gone, spans, kept if with_text else None, hashlib.sha256(kept).hexdigest()))
                    a = e
                    if len(rows) >= 1024:
                        yield _rows(rows, _KEPT)
                        rows = []
                if rows:
                    yield _rows(rows, _KEPT)

    return work


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, shard: int = SHARD, chunk: int = CHUNK, hot: int = HOT
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256): every document without the bytes of strings of ``SPAN`` bytes that a
    document with a smaller id holds too; ``kept`` are the bytes that remain (null without ``with_text``).

    Null texts are empty. Ids are integers; a row with a null id is kept whole and removes nothing from others; rows that share an
    id do not remove each other's bytes and are returned each. Texts under ``SPAN`` bytes are kept whole, long ones are read whole.
    Results do not depend on ``shard``, ``chunk`` and ``hot``. An empty table gives no rows; other columns of ``docs`` do not matter.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    table = _Bucketed(texts.mapInArrow(lambda batches: _packed(batches, shard), _SHARD), tasks)
    total = table.df.agg(F.sum("size")).first()[0] or 0
    ranges = max(tasks, math.ceil(total / RANGE))
    shards = table.df.select("shard", "ids", "ends", "text")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "r").sortWithinPartitions("r")

    def of_shard(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("shard").agg(F.collect_list(name).alias(name))  # at most a row for each range, a part of the shard each

    sent = stage(dealt(shards.mapInArrow(_anchors(ranges), _KEYS)).mapInArrow(_shared(hot), "shard bigint, keys binary"), "suffix-anchors")
    keys = stage(of_shard(sent, "keys"), "suffix-candidates")
    unstage(sent)
    wanted = shards.join(keys, "shard").select("shard", "ids", "ends", "text", "keys")
    said = stage(dealt(wanted.mapInArrow(_stretches(ranges), _STRETCHES)).mapInArrow(lambda batches: _owners(batches, chunk), _OWNERS), "suffix-owners")
    owners = of_shard(said, "said")
    both = shards.join(keys, "shard", "left").join(owners, "shard", "left").select("shard", "ids", "ends", "text", "keys", "said")
    done = stage(both.mapInArrow(_removed(ranges, with_text), _KEPT), "suffix-kept")
    unstage(keys)
    unstage(said)
    table.drop()
    return done


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of :func:`without_repeats`."""
    return without_repeats(docs, id_col, text_col, with_text=False).drop("kept")
