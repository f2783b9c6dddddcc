"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, digits, plus signs, schemes and identifier cues. Around each anchor a
deterministic parser takes the longest stretch of characters that its kind may contain, and reads entities inside that
stretch from the left; as no entity crosses the edge of its stretch, the spans are those of a scan of the whole text.
Kinds email, ip, card and phone follow fixed rules; kinds url and account are added by schemes and cues.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import id_type, map_texts

#: In order: the base kinds, then those that the anchors add.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4

_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DIGIT = frozenset("0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_HOST = _ALNUM | {"-"}
_MAIL = _LOCAL | {"@"}
_IP = _DIGIT | {"."}
_CARD = _DIGIT | frozenset(" -")
_PHONE = _DIGIT | frozenset(" ().-")
_URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")
#: Identifier cues, in lower case.
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")

_ip_re = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # what fails at the first of a run of digits fails at all of them
_card_re = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone_re = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_account_re = re.compile(r"[^0-9A-Za-z\n]{0,4}(?:(?:no|nr|number)\b[^0-9A-Za-z\n]{0,4})?([A-Za-z]{0,2}[0-9][0-9A-Za-z]*(?:[ -][0-9A-Za-z]*[0-9][0-9A-Za-z]*)*)")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("d", 1))
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    for s in ("http://", "https://", "ftp://"):
        found.add_word(s, ("s", len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            found.add_word(form, ("c", len(form)))
    found.make_automaton()
    return found


def _left(text: str, at: int, least: int, kind: frozenset) -> int:
    while at > least and text[at - 1] in kind:
        at -= 1
    return at


def _right(text: str, at: int, kind: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in kind:
        at += 1
    return at


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Around the at-sign at ``at``: a local part that begins at ``least`` at the earliest, and a name of two labels or more."""
    start, end = _left(text, at, least, _LOCAL), _right(text, at + 1, _HOST)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == ".":
        more = _right(text, end + 1, _HOST)
        if more == end + 1:
            break
        end, labels = more, labels + 1
    return (start, end) if labels > 1 else None


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _is_ip(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]  # a part may have any number of zeros
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _digits(found: str) -> str:
    return "".join(c for c in found if c in _DIGIT)


def _is_card(found: str) -> bool:
    d = _digits(found)
    return 13 <= len(d) <= 19 and luhn(d)


def _is_phone(found: str) -> bool:
    return 9 <= len(_digits(found)) <= 15


def spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, ordered by kind and start."""
    out: list[tuple[int, int, int]] = []
    mail = ip = card = phone = url = account = 0  # where the last stretch or entity of each kind ended
    for end, (what, size) in _automaton().iter(text):
        at = end + 1 - size
        if what == "d":
            if at >= ip:
                a, ip = _left(text, at, ip, _IP), _right(text, at, _IP)
                if ip - a >= 7:
                    out += [(1, a + m.start(), a + m.end()) for m in _ip_re.finditer(text[a:ip]) if _is_ip(m[0])]
            if at >= card:
                a, card = _left(text, at, card, _CARD), _right(text, at, _CARD)
                if card - a >= 13:
                    out += [(2, a + m.start(), a + m.end()) for m in _card_re.finditer(text[a:card]) if _is_card(m[0])]
        elif what == "@":
            if found := _email(text, at, mail):
                out.append((0, *found))
                mail = found[1]
        elif what == "+":
            if at >= phone and end + 1 < len(text) and text[end + 1] in _DIGIT:
                m = _phone_re.match(text[at : _right(text, at + 1, _PHONE)])
                if m:
                    phone = at + m.end()
                    if _is_phone(m[0]):
                        out.append((3, at, phone))
        elif what == "s":
            if at >= url and not (at and text[at - 1] in _ALNUM) and end + 1 < len(text) and text[end + 1] in _ALNUM:
                stop = end + 1
                while stop < len(text) and text[stop] not in _URL_END:
                    stop += 1
                while text[stop - 1] in ".,;:!?)]'":
                    stop -= 1
                out.append((4, at, stop))
                url = stop
        elif at >= account and not (at and text[at - 1] in _ALNUM):
            if m := _account_re.match(text, end + 1, min(len(text), end + 80)):
                if 6 <= len(_digits(m[1])) <= 34:
                    out.append((5, m.start(1), m.end(1)))
                    account = m.end(1)
    return sorted(out)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, spans) with spans an array of (kind, start_at, end_at), offsets in code points, end exclusive.

    Null and empty texts have no spans. Whole texts are read; repeated rows each give a row.
    """

    def rows(ids, texts):
        found = [[{"kind": KINDS[k], "start_at": a, "end_at": b} for k, a, b in spans(t.decode())] for t in texts]
        return {"doc_id": ids, "spans": found}

    schema = f"doc_id {id_type(docs, id_col).simpleString()}, spans array<struct<kind: string, start_at: int, end_at: int>>"
    return map_texts(docs, rows, schema, id_col, text_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in angle brackets; where spans overlap, the earliest and then longest stands."""

    def clean(text: str) -> str:
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in spans(text)):
            if a >= at:
                out += [text[at:a], f"<{KINDS[k]}>"]
                at = b
            elif b > at:
                at = b
        return "".join([*out, text[at:]])

    def rows(ids, texts):
        return {"doc_id": ids, "text": [clean(t.decode()) for t in texts]}

    return map_texts(docs, rows, f"doc_id {id_type(docs, id_col).simpleString()}, text string", id_col, text_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): :func:`entities` with counts, a digest of the base kinds and all spans joined."""

    def rows(ids, texts):
        out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans")}
        for t in texts:
            found = spans(t.decode())
            base = [s for s in found if s[0] < BASE]
            for k, name in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                out[name].append(sum(s[0] == k for s in base))
            out["n_added"].append(len(found) - len(base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(found))
        return {"doc_id": ids} | out

    counts = ", ".join(f"{c} bigint" for c in ("n_email", "n_ip", "n_card", "n_phone"))
    return map_texts(docs, rows, f"doc_id {id_type(docs, id_col).simpleString()}, {counts}, base_sha256 string, spans string, n_added bigint", id_col, text_col)
