"""Byte-level BPE by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens: its state is the last token, and an arc
x -> y says that y may follow x. Before any merge every byte may follow every byte. The gadget of the merge (a, b) -> c
adds the state c, lets c be entered from where a is entered, left to where b is left, and removes the arc a -> b (and,
where a = b, a -> c: a run of a's pairs from the left). The gadgets are kept as they are made (copies by reference: for
c, its two parts and its time), so the automaton of 50,257 states takes a few megabytes; an arc is resolved by following
the copies back to a removed arc or to bytes, and then kept in a table.

A word has exactly one path, and so has each of its prefixes. Encoding follows the arcs, at each state the longest token
first, and never enters twice a prefix from which no path goes on. Decoding emits the arc labels.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from .common import id_type, map_texts

#: The pre-split of byte-level BPE, as published for it; letters come first, as most pieces are words, and nothing else begins like them.
PIECES = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points (hexadecimal ranges) that became letters or numbers after Unicode 16, which the library's pre-split follows.
AFTER_16 = """
    558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf
    10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
    16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81
    1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479
    3d000-3fc3f
"""
#: Entries of a worker's table of encoded words; it is emptied when full, so that memory is bounded.
MOST_WORDS = 200_000
MOST_ARCS = 500_000


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: visible Latin-1 characters stand for themselves, the rest for 256 onwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_NONE: frozenset[int] = frozenset()


class Automaton:
    """Compiled from ``vocab`` (bytes -> id) and ``merges`` (pairs of ids and the id made, in order)."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.vocab = vocab
        self.label = {i: b for b, i in vocab.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.time: dict[int, int] = {}
        self.removed: dict[tuple[int, int], int] = {}
        for t, (a, b, c) in enumerate(merges, 1):
            self._gadget(t, a, b, c)
        self.arcs: dict[int, bool] = {}  # x << 32 | y
        states = max(vocab.values(), default=-1) + 1
        self.longest = max(map(len, vocab), default=1)
        self.size, self.shorter = [0] * states, [-1] * states  # shorter: the longest token that is a proper prefix, or -1
        self.step: dict[int, int] = {}  # node << 8 | byte -> node of the tree of tokens
        self.ends = [-1]  # the token that ends at a node, or -1
        for token in sorted(vocab):
            node, best, y = 0, -1, vocab[token]
            for byte in token:
                best = self.ends[node] if self.ends[node] >= 0 else best
                key, new = node << 8 | byte, len(self.ends)
                node = self.step.setdefault(key, new)
                if node == new:
                    self.ends.append(-1)
            self.ends[node], self.shorter[y], self.size[y] = y, best, len(token)

    def _gadget(self, t: int, a: int, b: int, c: int) -> None:
        self.left[c], self.right[c], self.time[c] = a, b, t
        self.removed[a, b] = t

    def _arc(self, x: int, y: int, now: int) -> bool:
        """Whether y may follow x after the gadgets up to ``now``."""
        while True:
            if self.removed.get((x, y), now + 1) <= now:
                return False
            tx, ty = self.time.get(x, 0), self.time.get(y, 0)
            if tx == ty == 0:
                return True
            if ty > tx:  # y copied its entries from its first part
                if x == self.left[y] == self.right[y]:
                    return False
                y, now = self.left[y], ty - 1
            elif x == y:  # c after c: its last part before its first
                x, y, now = self.right[x], self.left[y], tx - 1
                if x == y:  # a = b: the run of four pairs up from the left
                    return True
            else:
                x, now = self.right[x], tx - 1

    def arc(self, x: int, y: int) -> bool:
        known = self.arcs.get(x << 32 | y)
        if known is None:
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            known = self.arcs[x << 32 | y] = self._arc(x, y, len(self.time) + 1)
        return known

    def encode(self, word: bytes) -> list[int]:
        """The path of ``word``: from each state the longest token first; a prefix whose (only) path leads nowhere is not tried again."""
        arcs, size, shorter, step, ends, n, longest = self.arcs, self.size, self.shorter, self.step, self.ends, len(word), self.longest
        out: list[int] = []
        dead = _NONE
        i, last, y = 0, -1, -1
        forward = True
        while i < n:
            if forward:
                node, y = 0, -1
                for byte in word[i : i + longest]:
                    node = step.get(node << 8 | byte)
                    if node is None:
                        break
                    if (token := ends[node]) >= 0:
                        y = token
            while y >= 0:
                if i + size[y] not in dead:
                    if last < 0:
                        break
                    known = arcs.get(last << 32 | y)
                    if self.arc(last, y) if known is None else known:
                        break
                y = shorter[y]
            forward = y >= 0
            if forward:
                out.append(y)
                i, last = i + size[y], y
            else:
                if dead is _NONE:
                    dead = set()
                dead.add(i)
                y = out.pop()
                i -= size[y]
                y, last = shorter[y], out[-1] if out else -1
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


class Tokenizer:
    """An automaton with the pre-split and the special tokens of a vocabulary file in the tokenizers library's form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_of_char()
        raw = {t: bytes(of[ch] for ch in t) for t in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        plain = {raw[t]: i for t, i in ids.items() if t not in special}
        self.automaton = Automaton(plain, [(ids[a], ids[b], ids[a + b]) for a, b in merges])
        self.automaton.label |= {i: s.encode() for s, i in special.items()}
        self.special = special
        self.names = list(map(str, range(max([*ids.values(), *special.values()], default=-1) + 1)))
        new = "[" + "".join(rf"\U{int(a, 16):08x}-\U{int(b, 16):08x}" for a, b in (r.split("-") for r in AFTER_16.split())) + "]"
        self.new, self.late = regex.compile(new), regex.compile(r"[^\x00-\u0557]")  # the second, cheap one rules the first out for most texts
        self.pieces = regex.compile(PIECES)
        self.pieces_16 = regex.compile(r"(?V1)" + PIECES.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{new})").replace(r"\p{L}+", rf"[\p{{L}}--{new}]+").replace(r"\p{N}+", rf"[\p{{N}}--{new}]+"))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            words, pieces = self.words, self.pieces_16 if self.late.search(part) and self.new.search(part) else self.pieces
            for piece in pieces.findall(part):
                ids = words.get(piece)
                if ids is None:
                    if len(words) >= MOST_WORDS:
                        words.clear()
                    ids = tuple(self.automaton.encode(piece.encode()))
                    if len(piece) <= 64:
                        words[piece] = ids
                out += ids
        return out

    def decode(self, ids) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, compiled once in each worker."""
    return Tokenizer(path)


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): token ids of each whole text and the text that they decode to.

    Null texts count as empty: no ids, an empty text. Repeated rows are encoded each; very long texts and words take
    time in proportion to their length. The file at ``path`` must be readable on every executor.
    """
    path = path or public_path()

    def rows(ids, texts):
        t = tokenizer(path)
        found = [t.encode(x.decode()) for x in texts]
        return {"doc_id": ids, "ids": found, "decoded": [t.decode(x) for x in found]}

    return map_texts(docs, rows, f"doc_id {id_type(docs, id_col).simpleString()}, ids array<int>, decoded string", id_col, text_col)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of :func:`encoded`, taken where the ids are made, so they never leave the worker."""
    path = path or public_path()

    def rows(ids, texts):
        t = tokenizer(path)
        out = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for x in texts:
            found = t.encode(x.decode())
            out["n_tokens"].append(len(found))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(t.names.__getitem__, found)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(t.decode(found).encode()).hexdigest())
        return out

    schema = f"doc_id {id_type(docs, id_col).simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, rows, schema, id_col, text_col)
