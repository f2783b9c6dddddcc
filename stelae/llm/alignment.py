"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and which pairs are usual.

A text is encoded by a byte-level BPE (A) and by a sentence-piece model (B), both on the same bytes (a blank and the text).
Two tokens are linked where their byte ranges overlap; places where tokens of both end cut a text into groups. Neither
tokenizer has a token that goes on over a single blank after a word, so texts are cut there, and each different word is
encoded and aligned once in a worker's table.

1. One pass over the texts writes, for each piece of up to 512 documents, their counts and groups, and their links by
   stripe of B ids: pairs of ids, and the documents that hold each, packed.
2. Pair counts: tasks add up what they read, by block of B ids; each block is a dense matrix (its B ids x all A ids) into
   which ``np.add.at`` puts the partial counts. Row maxima give the best partners of a B id. A block's size is fixed by the
   vocabularies, whatever the corpus.
3. Scores: a stripe's counts go to the tasks that hold its links, which are dealt by stripe and, where a stripe has many
   links, by salt; sums by document are packed by piece and meet there.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import byte_of_char
from .common import id_and_bytes, id_type, pieces, stage, unstage

#: Stripes of B ids and blocks in each; links (pairs in documents) of a stripe that one task scores.
STRIPES, BLOCKS, LINKS = 32, 8, 4 << 20
#: Words and bytes of a worker's table; it is emptied when full. Longer words are not kept.
MOST_WORDS, MOST_BYTES, LONG = 200_000, 64 << 20, 64
_LOW = 0xFFFF_FFFF
_PLACE = re.compile(r"(?<=\S)(?= \S)")


def public_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Both tokenizers and a table of aligned words."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = byte_of_char()
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(of[ch] for ch in token) if all(ch in of for ch in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: Whether texts may be cut before single blanks: no piece goes on over one, and B takes texts as they are.
        self.cuts = not any(re.search("[^▁]▁", p) for p in names) and self.b.encode("a  b  c") == self.b.encode("a") + self.b.encode(" b ") + self.b.encode("c")
        self.text_a = [[f"{i}{end}" for i in range(size)] for end in ",|"]
        self.text_b = [[f"{i}{end}" for i in range(len(names))] for end in ",;"]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.held = 0
        self.counts: list[np.ndarray] = []  # rows (tokens of A, of B, groups, links, whether the bytes are the word's)
        self.links: list[np.ndarray] = []
        self.ready: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def words(self, text: str) -> list[str]:
        return _PLACE.split(f" {text}") if self.cuts else [f" {text}"]

    def learn(self, words: list[str]) -> None:
        """Encode and align words, all at once, and put them into the table."""
        a = [e.ids for e in self.a.encode_batch(words, add_special_tokens=False)]
        b = self.b.encode([w[1:] for w in words])
        raw = [w.encode() for w in words]
        get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        good = np.array([b"".join(map(get_a, x)) == w == b"".join(map(get_b, y)) for w, x, y in zip(raw, a, b)], bool)
        which = np.flatnonzero(good)
        n_a, n_b = (np.array([len(x[k]) for k in which], np.int64) for x in (a, b))
        ids_a, ids_b = (np.array([i for k in which for i in x[k]], np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        end_word = np.cumsum(np.array([len(raw[k]) for k in which], np.int64))
        both, cut = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b)  # each stretch between two ends is a link
        pair = ids_b[np.searchsorted(end_b, both)] << 32 | ids_a[np.searchsorted(end_a, both)]
        n_links = np.diff(np.searchsorted(both, end_word, "right"), prepend=0)
        n_groups = np.diff(np.searchsorted(cut, end_word, "right"), prepend=0)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)].astype(int).tolist() for g in (group_a, group_b))
        text = [self.text_a[e][i] for e, i in zip(last_a, ids_a.tolist())] + [self.text_b[e][i] for e, i in zip(last_b, ids_b.tolist())]
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable").tolist()
        upto = np.cumsum(n_a + n_b).tolist()
        said = iter("".join([text[i] for i in order[at:to]]) for at, to in zip([0, *upto[:-1]], upto))
        counts = np.zeros((len(words), 5), np.int64)
        counts[which] = np.stack([n_a, n_b, n_groups, n_links, np.ones(len(which), np.int64)], axis=1)
        for k, w in enumerate(words):
            self.known[w] = len(self.groups)
            self.groups.append(next(said) if good[k] else "")
            self.held += 8 * len(w) + 4 * len(self.groups[-1])
        self.counts.append(counts)
        self.links.append(pair)
        self.ready = None

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts of each word, where its links begin, links)."""
        if self.ready is None:
            self.counts, self.links = [np.concatenate(self.counts)], [np.concatenate(self.links)]
            self.ready = self.counts[0], np.cumsum(self.counts[0][:, 3]) - self.counts[0][:, 3], self.links[0]
        return self.ready

    def align(self, texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts (rows of tokens of A, of B, groups, links; groups as text) and their links: (pair = B << 32 | A, text, times), in this order."""
        if len(self.known) > MOST_WORDS or self.held > MOST_BYTES:
            self.clear()
        split = [self.words(t.decode()) if t else [] for t in texts]
        if new := list(dict.fromkeys(w for words in split for w in words if w not in self.known)):
            self.learn(new)
        at = [list(map(self.known.__getitem__, words)) for words in split]
        if not self.groups:
            return np.zeros((len(texts), 4), np.int64), [""] * len(texts), *(np.empty(0, np.int64) for _ in range(3))
        counts, begin, links = self.table()
        n = np.array([len(x) for x in at], np.int64)
        flat, doc = np.array([i for x in at for i in x], np.int64), np.repeat(np.arange(len(texts)), n)
        total = np.zeros((len(texts), 5), np.int64)
        np.add.at(total, doc, counts[flat])
        fine = (total[:, 4] == n) & (n > 0)
        total[~fine] = 0
        said = ["".join(map(self.groups.__getitem__, x))[:-1] if ok else "" for x, ok in zip(at, fine.tolist())]
        use = fine[doc]
        of, times = np.unique(doc[use] << 32 | flat[use], return_counts=True)  # each word of a text once
        doc, word = of >> 32, of & _LOW
        many = counts[word, 3]
        place = np.repeat(begin[word] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pair, doc, times = links[place], np.repeat(doc, many), np.repeat(times, many)
        order = np.lexsort((doc, pair))
        pair, doc, times = pair[order], doc[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])[: len(pair)])
        for w in [w for w in new_long(self.known, split)]:
            self.held += len(w)
        return total[:, :4], said, pair[new], doc[new], np.add.reduceat(times, new) if len(new) else times


def new_long(known: dict[str, int], split: list[list[str]]):
    """Words too long to be kept: they leave the table by name (their rows go when the table is emptied)."""
    for words in split:
        for w in words:
            if len(w) > LONG and known.pop(w, None) is not None:
                yield w


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """Compiled once in each worker."""
    return Aligner(path_a, path_b)


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]), [len(x)]])


def _made(spec: T.StructType, path_a: str, path_b: str, with_groups: bool):
    """Of each piece a row for its documents, and one for each stripe of its links."""
    arrow = to_arrow_schema(spec)

    def work(batches):
        task, made = TaskContext.get().partitionId(), 0
        x = aligner(path_a, path_b)
        for batch in batches:
            for part in pieces(batch):
                if not part.num_rows:
                    continue
                total, said, pair, doc, times = x.align(part.column(1).to_pylist())
                piece, made = task << 32 | made, made + 1
                sha = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
                rows = [{"piece": piece, "ids": part.column(0).to_pylist(), "n": total.ravel().tolist(), "groups": said if with_groups else None, "sha": sha}]
                stripe = (pair >> 32) % STRIPES
                order = np.argsort(stripe, kind="stable")
                stripe, pair, doc, times = stripe[order], pair[order], doc[order], times[order]
                cut = _cuts(stripe)
                for i, j in zip(cut[:-1], cut[1:]):
                    begin = _cuts(pair[i:j])
                    rows.append({
                        "piece": piece, "stripe": int(stripe[i]), "entries": int(j - i), "pairs": pair[i:j][begin[:-1]].tobytes(), "sizes": np.diff(begin).astype(np.int32).tobytes(),
                        "docs": doc[i:j].astype(np.uint16).tobytes(), "times": times[i:j].astype(np.int32).tobytes(), "totals": np.add.reduceat(times[i:j], begin[:-1]).tobytes(),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return work


_BLOCK = "stripe int, block int, pairs binary, counts binary"
_BEST = "stripe int, pairs binary, counts binary, best binary"


def _binary(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def _summed(pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pair, kind="stable")
    pair, count = pair[order], count[order]
    at = _cuts(pair)[:-1]
    return pair[at], np.add.reduceat(count, at) if len(at) else count


def _partial(batches):
    """What a task's pieces hold of each pair, by block of B ids."""
    pair, count = np.empty(0, np.int64), np.empty(0, np.int64)

    def blocks():
        block = (pair >> 32) % (STRIPES * BLOCKS)
        order = np.argsort(block, kind="stable")
        b, p, c = block[order], pair[order], count[order]
        cut = _cuts(b)
        return _binary([(int(b[i]) % STRIPES, int(b[i]), p[i:j].tobytes(), c[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])], _BLOCK)

    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            rows = batch.slice(k, 64)
            new = [(np.frombuffer(p.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.int64)) for p, c in zip(rows.column(0), rows.column(1))]
            pair, count = _summed(np.concatenate([pair, *(p for p, _ in new)]), np.concatenate([count, *(c for _, c in new)]))
            if len(pair) > 4 << 20:
                yield blocks()
                pair, count = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(pair):
        yield blocks()


def _best(size_a: int, size_b: int):
    """Blocks as dense matrices of counts, B ids by A ids; a row's maximum is its best."""

    def work(batches):
        grid = np.zeros((-(-size_b // (STRIPES * BLOCKS)), size_a), np.int64)
        now = None

        def done():
            row, a = np.nonzero(grid)
            count = grid[row, a]
            best = count == grid.max(axis=1)[row]
            pair = (row * (STRIPES * BLOCKS) + now) << 32 | a
            order = np.argsort(pair)
            grid[:] = 0
            return _binary([(now % STRIPES, pair[order].tobytes(), count[order].tobytes(), best[order].tobytes())], _BEST)

        for batch in batches:
            for block, pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if now is not None and block != now:
                    yield done()
                now = block
                pair = np.frombuffer(pairs.as_buffer(), np.int64)
                np.add.at(grid, ((pair >> 32) // (STRIPES * BLOCKS), pair & _LOW), np.frombuffer(counts.as_buffer(), np.int64))
        if now is not None:
            yield done()

    return work


_SCORED = "piece bigint, sums binary"
_SENT = ["stripe", "salt", "kind", "piece", "pairs", "counts", "best", "sizes", "docs", "times"]


def _scores(batches):
    """On rows in order of (stripe, salt, kind): a stripe's counts first, then its links; (best links, counts over links) of each piece's documents."""
    now, parts, held = None, [], {}
    pair = count = best = None

    def out():
        return _binary([(piece, x.tobytes()) for piece, x in held.items()], _SCORED)

    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
        for k, (stripe, salt, kind, piece) in enumerate(keys):
            get = lambda i, t: np.frombuffer(batch.column(i)[k].as_buffer(), t)  # noqa: B023, E731
            if (stripe, salt) != now:
                now, parts, pair = (stripe, salt), [], None
            if kind == 0:
                parts.append((get(4, np.int64).copy(), get(5, np.int64).copy(), get(6, bool).copy()))
                continue
            if pair is None:
                pair, count, best = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(pair)
                pair, count, best = pair[order], count[order], best[order]
            sizes, docs, times = get(7, np.int32), get(8, np.uint16), get(9, np.int32).astype(np.int64)
            at = np.repeat(np.searchsorted(pair, get(4, np.int64)), sizes)
            sums = held.get(piece)
            most = int(docs.max()) + 1
            if sums is None or len(sums) < most:
                wider = np.zeros((most, 2), np.int64)
                if sums is not None:
                    wider[: len(sums)] = sums
                sums = held[piece] = wider
            np.add.at(sums, (docs, 0), times * best[at])
            np.add.at(sums, (docs, 1), times * count[at])
            if len(held) >= 4096:
                yield out()
                held.clear()
    if held:
        yield out()


def _joined(spec: T.StructType, with_groups: bool):
    arrow = to_arrow_schema(spec)

    def work(batches):
        for batch in batches:
            for ids, n, groups, sha, sums in zip(*(batch.column(i) for i in range(5))):
                total = np.zeros((len(ids), 2), np.int64)
                for s in sums.as_py() or ():
                    part = np.frombuffer(s, np.int64).reshape(-1, 2)
                    total[: len(part)] += part
                counts = n.values.to_numpy(zero_copy_only=False).reshape(-1, 4)
                columns = [ids.values, *counts.T, *total.T, groups.values if with_groups else pa.nulls(len(ids), pa.string()), sha.values]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return work


def _links(docs: DataFrame, paths: tuple[str, str], id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    spec = T.StructType([T.StructField("piece", T.LongType()), T.StructField("ids", T.ArrayType(id_type(docs, id_col)))])
    for f in T._parse_datatype_string("n array<bigint>, groups array<string>, sha array<string>, stripe int, entries bigint, pairs binary, sizes binary, docs binary, times binary, totals binary"):
        spec.add(f)
    return stage(id_and_bytes(docs, id_col, text_col).mapInArrow(_made(spec, *paths, with_groups), spec), "alignment-links")


def _counted(links: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(stripe, pairs, counts, best) by block."""
    import sentencepiece
    from tokenizers import Tokenizer

    size_a = max(Tokenizer.from_file(paths[0]).get_vocab(with_added_tokens=True).values()) + 1
    size_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    partial = links.where("stripe is not null").select("pairs", "totals").mapInArrow(_partial, _BLOCK)
    dealt = partial.select("block", "pairs", "counts").repartition("block").sortWithinPartitions("block")
    return stage(dealt.mapInArrow(_best(size_a, size_b), _BEST), "alignment-counts")


def pair_counts(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, count, best): how many links of the whole corpus join the two ids, and whether that is the B id's highest."""
    links = _links(docs, paths or public_paths(), id_col, text_col, False)
    counts = _counted(links, paths or public_paths())
    unstage(links)

    def rows(batches):
        for batch in batches:
            for p, c, b in zip(*(batch.column(i) for i in (1, 2, 3))):
                pair = np.frombuffer(p.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair & _LOW), pa.array(pair >> 32), pa.array(np.frombuffer(c.as_buffer(), np.int64)), pa.array(np.frombuffer(b.as_buffer(), bool))], ["a", "b", "count", "best"])

    return counts.mapInArrow(rows, "a bigint, b bigint, count bigint, best boolean")


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256) of each whole text.

    ``groups`` is `a1,a2|b1;a3|b2,b3`: the ids of A and of B in each group (null without ``with_groups``). ``n_best`` are the
    links whose count is the highest of their B id, ties included; ``count_sum`` is the sum of counts over links. Null and empty
    texts, and those whose bytes one of the tokenizers does not keep, have zeros and an empty digest. Rows are aligned each,
    whatever their ids; an empty table gives no rows; other columns of ``docs`` do not matter. Both files must be readable
    on every executor.
    """
    paths = paths or public_paths()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = _links(docs, paths, id_col, text_col, with_groups)
    counts = _counted(links, paths)
    linked = links.where("stripe is not null")
    salts = linked.groupBy("stripe").agg(F.ceil(F.sum("entries") / LINKS).cast("int").alias("salts"))  # a row for each stripe
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    held = linked.join(F.broadcast(salts), "stripe").withColumn("salt", F.pmod(F.xxhash64("piece"), F.col("salts")).cast("int"))
    held = held.select("stripe", "salt", F.lit(1).alias("kind"), "piece", "pairs", *none("counts", "best"), "sizes", "docs", "times")
    known = counts.join(F.broadcast(salts), "stripe").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    known = known.select("stripe", "salt", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("piece"), "pairs", "counts", "best", *none("sizes", "docs", "times"))
    placed = held.unionByName(known).select(*_SENT).repartition(tasks, "stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")
    sums = placed.mapInArrow(_scores, _SCORED).groupBy("piece").agg(F.collect_list("sums").alias("sums"))  # a row for each task at most
    spec = T.StructType([T.StructField("doc_id", id_type(docs, id_col))])
    for f in T._parse_datatype_string("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string, groups_sha256 string"):
        spec.add(f)
    told = links.where("stripe is null").select("piece", "ids", "n", "groups", "sha").join(sums, "piece", "left")
    done = stage(told.select("ids", "n", "groups", "sha", "sums").mapInArrow(_joined(spec, with_groups), spec), "alignments")
    unstage(links)
    unstage(counts)
    return done


def digests(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`alignments` without the groups' text, which then never leaves the workers."""
    return alignments(docs, paths, id_col, text_col, with_groups=False).drop("groups")
