"""Transcription: editors' marks, folding to canonical letters with offsets, sound and script renderings.

These need state along a text, which column expressions lack, so each is one small function per row inside a pandas UDF.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd

from .lazy import pandas_udf

SPAN = "struct<kind:string,start:int,end:int,source:string>"
RESULT = (
    f"struct<canonical:string,phonetic:string,old_italic:string,source_system:string,tokens:array<string>,confidence:double,warnings:array<string>,apparatus:array<{SPAN}>>"
)


@dataclass(frozen=True)
class Language:
    """A script's letters and habits. ``letters`` lists canonical letter, code point (hexadecimal), sound and spellings."""

    name: str
    letters: str
    script: tuple[int, int]
    final: tuple[str, ...] = ()
    clusters: tuple[str, ...] = ()

    def rows(self) -> list[list[str]]:
        return [r.split() for r in self.letters.strip().splitlines()]


#: Letter, code point, sound, spellings.
ETRUSCAN = Language(
    "Etruscan",
    """
a 10300 a A a
c 10302 k C c
e 10304 e E e
v 10305 v V v w W
z 10306 ts Z z
h 10307 h H h
θ 10308 tʰ TH Th th θ Θ t' T' THH thh
i 10309 i I i
k 1030A k K k
l 1030B l L l
m 1030C m M m
n 1030D n N n
p 10310 p P p
ś 10311 ʃ Ś ś SH Sh sh S2 s2 S' s' SS ss
q 10312 k Q q
r 10313 r R r
ξ 1030E s ξ
s 10314 s S s
t 10315 t T t
u 10316 u U u
φ 10318 pʰ PH Ph ph φ Φ p' P' PHH phh
χ 10317 kʰ CH Ch ch KH Kh kh χ Χ k' K' CHH chh
f 1031A f F f
""",
    (0x10300, 0x1032F),
    final=("m",),
    clusters=("kt", "tθ", "pφ", "kχ"),
)
#: Letters of related scripts, those of the first but for sound and spellings.
FALISCAN = Language(
    "Faliscan",
    """
a 10300 a A a
b 10301 b B b
c 10302 k C c K k
d 10303 d D d
e 10304 e E e
v 10305 w V v W w
z 10306 dz Z z
h 10307 h H h
θ 10308 tʰ TH Th th θ Θ
i 10309 i I i
l 1030B l L l
m 1030C m M m
n 1030D n N n
o 1030F o O o
p 10310 p P p
q 10312 kw Q q
r 10313 r R r
s 10314 s S s
t 10315 t T t
u 10316 u U u
f 1031A f F f
g 1031B g G g
""",
    (0x10300, 0x1032F),
)
OSCAN = Language(
    "Oscan",
    """
a 10300 a A a
b 10301 b B b
d 10303 d D d
e 10304 e E e
v 10305 w V v W w
z 10306 ts Z z
h 10307 h H h
i 10309 i I i
í 10309 iː Í í ii II Ii
k 1030A k K k C c
l 1030B l L l
m 1030C m M m
n 1030D n N n
o 1030F o O o
p 10310 p P p
r 10313 r R r
s 10314 s S s
t 10315 t T t
u 10316 u U u
ú 10316 uː Ú ú uu UU Uu
f 1031A f F f
g 1031B g G g
""",
    (0x10300, 0x1032F),
)
_TYRSENIAN = """
a 10300 a A a
e 10304 e E e
v 10305 v V v W w
z 10306 ts Z z
h 10307 h H h
θ 10308 tʰ TH Th th θ Θ
i 10309 i I i
k 1030A k K k C c
l 1030B l L l
m 1030C m M m
n 1030D n N n
p 10310 p P p
ś 10311 ʃ Ś ś SH Sh sh S2 s2
r 10313 r R r
s 10314 s S s
t 10315 t T t
u 10316 u U u
φ 10318 pʰ PH Ph ph φ Φ
χ 10317 kʰ CH Ch ch KH Kh kh χ Χ
"""
RHAETIC = Language("Rhaetic", _TYRSENIAN, (0x10300, 0x1032F), clusters=("kt", "tθ", "pφ", "kχ"))
LEMNIAN = Language("Lemnian", _TYRSENIAN + "o 1030F o O o\n", (0x10300, 0x1032F))
LANGUAGES = {"etruscan": ETRUSCAN, "faliscan": FALISCAN, "oscan": OSCAN, "lemnian": LEMNIAN, "rhaetic": RHAETIC}


def register(identifier: str, language: Language) -> None:
    """Add a language; identifiers are lower-case letters, digits and underscores."""
    if not re.fullmatch(r"[a-z][a-z0-9_]*", identifier):
        raise ValueError(f"not an identifier: {identifier!r}")
    LANGUAGES[identifier] = language
    _tables.cache_clear()


#: Commands of typeset editions.
COMMANDS = {r"\d{h}": "θ", r"\theta": "θ", r"\d{p}": "φ", r"\phi": "φ", r"\d{k}": "χ", r"\chi": "χ", r"\'{s}": "ś", r"\v{s}": "ś"}
_MARKS = {"[": ("]", "supplied"), "(": (")", "expansion"), "⸢": ("⸣", "unclear")}
_DOT = "\u0323"
_QUIET = set(" .,;:-'\n\t")
_pieces = re.compile(r"-{3,}|.", re.S)


@lru_cache(maxsize=16)
def _tables(name: str):
    lang = LANGUAGES[name]
    rows = lang.rows()
    spell = {s: r[0] for r in rows for s in r[3:]}
    fold = re.compile("|".join(sorted(map(re.escape, spell), key=len, reverse=True)))
    glyph = {r[0]: chr(int(r[1], 16)) for r in rows}
    return spell, fold, glyph, {g: c for c, g in glyph.items()}, {r[0]: r[2] for r in rows}


def leiden(raw: str) -> tuple[str, list[tuple[str, int, int, str]], list[str]]:
    """(text, spans, warnings): the reading without marks, and what the marks said of it.

    ``[abc]`` is supplied, ``(abc)`` an expansion, half brackets and dots below are unclear. A bracket of dots, dashes,
    ellipses and blanks alone is a gap of no width; so are three dashes or more outside brackets. Marks that do not match
    are dropped with a warning. Spans hold offsets into the text, end exclusive, in order.
    """
    out: list[str] = []
    spans: list[tuple[str, int, int, str]] = []
    warnings: list[str] = []
    waiting: list[tuple[str, int, int]] = []
    closing = {c: o for o, (c, _) in _MARKS.items()}

    def gap(at: int, source: str, inner: str) -> None:
        spans.append(("gap", at, at, source))
        warnings.append("gap of unknown width" if "…" in inner else f"unrestorable gap of width {len(re.sub(r'[^.-]', '', inner))}")

    for m in _pieces.finditer(raw):
        piece = m[0]
        if piece in _MARKS:
            waiting.append((piece, m.start(), len(out)))
        elif piece in closing:
            if not waiting or waiting[-1][0] != closing[piece]:
                warnings.append("unbalanced editorial bracket")
                continue
            mark, begun, at = waiting.pop()
            source = raw[begun : m.end()]
            inner = source[1:-1]
            if mark == "[" and inner.strip() and not re.search(r"[^.\-… ]", inner):
                del out[at:]
                gap(at, source, inner)
            else:
                spans.append((_MARKS[mark][1], at, len(out), source))
        elif len(piece) > 1 and not waiting:
            gap(len(out), piece, piece)
        elif piece == _DOT:
            if out:
                spans.append(("unclear", len(out) - 1, len(out), out[-1] + piece))
            else:
                warnings.append("stray combining underdot")
        elif _DOT in (apart := unicodedata.normalize("NFD", piece)):
            bare = unicodedata.normalize("NFC", apart.replace(_DOT, ""))
            spans.append(("unclear", len(out), len(out) + len(bare), piece))
            out += bare
        else:
            out += piece
    warnings += ["unbalanced editorial bracket"] * len(waiting)
    return "".join(out), sorted(spans, key=lambda s: s[1:3]), warnings


def source_system(text: str, name: str = "etruscan") -> str:
    """In this order: script glyphs, scholars' letters, typeset commands, capitals alone, digraphs in capitals; else web-safe."""
    lo, hi = LANGUAGES[name].script
    if any(lo <= ord(c) <= hi for c in text):
        return "unicode"
    if re.search("[θφχśΘΦΧŚ]", text):
        return "philological"
    if re.search(r"\\d\{|\\theta|\\phi", text):
        return "latex"
    letters = [c for c in text if c.isalpha()]
    if letters and all(c.isupper() for c in letters) or re.search("[TPCS]H", text):
        return "cie"
    return "web_safe"


class Trace:
    """A text and, for each of its characters, the stretch of the first text that it came from."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, parts: list[tuple[str, int, int]]) -> Trace:
        """``parts``: (new text, from, to) over the present text, in order and without holes."""
        new = Trace("")
        new.text = "".join(t for t, _, _ in parts)
        for t, a, b in parts:
            new.begin += [self.begin[a] if a < len(self.begin) else 0] * len(t)
            new.end += [self.end[b - 1]] * len(t)
        return new

    def place(self, start: int, end: int) -> tuple[int, int, bool]:
        """Where a span of the first text lies now, and whether its ends were widened to whole characters."""
        first = next((i for i, e in enumerate(self.end) if e > start), len(self.text))
        if start == end:
            at = next((i for i, b in enumerate(self.begin) if b >= start), len(self.text))
            return at, at, False
        last = max((i + 1 for i, b in enumerate(self.begin) if b < end), default=0)
        last = max(first, last)
        return first, last, first < last and (self.begin[first] < start or self.end[last - 1] > end)


def _folded(trace: Trace, name: str, warnings: list[str]) -> Trace:
    spell, fold, *_ = _tables(name)
    parts, at = [], 0
    while at < len(trace.text):
        if m := fold.match(trace.text, at):
            parts.append((spell[m[0]], at, m.end()))
            at = m.end()
            continue
        c = trace.text[at]
        new = spell.get(c.lower(), c.lower() if c.isalpha() else c)
        if c not in _QUIET and c.lower() not in spell:
            warnings.append(f"Unknown character '{c}' at position {at}")
        parts.append((new, at, at + 1))
        at += 1
    return trace.rewrite(parts)


def normalize(text: str | None, name: str = "etruscan", system: str = "auto") -> dict:
    """The whole chain: NFC, editors' marks, source system, commands and glyphs to letters, folding, spans carried along,
    phonotactics, sounds, script. Confidence loses 0.15 for each warning. Null gives an empty result."""
    spell, _, glyph, letter, sound = _tables(name)
    lang = LANGUAGES[name]
    plain, spans, warnings = leiden(unicodedata.normalize("NFC", (text or "").strip()))
    used = source_system(plain, name) if system == "auto" else system
    trace = Trace(plain)
    if used == "latex":
        cmd = re.compile("|".join(map(re.escape, COMMANDS)) + "|.", re.S)
        trace = trace.rewrite([(COMMANDS.get(m[0], m[0]), m.start(), m.end()) for m in cmd.finditer(plain)])
    elif used == "unicode":
        trace = trace.rewrite([(letter.get(c, c), i, i + 1) for i, c in enumerate(plain)])
    trace = _folded(trace, name, warnings)
    apparatus = []
    for kind, a, b, source in spans:
        start, end, wide = trace.place(a, b)
        if wide:
            warnings.append("span boundary crossed a digraph; widened")
        apparatus.append({"kind": kind, "start": start, "end": end, "source": source})
    canonical = trace.text
    tokens = canonical.split()
    for w in tokens:
        warnings += [f"Word '{w}' ends with '{x}' (forbidden in {lang.name})" for x in lang.final if w.endswith(x)]
        warnings += [f"Word '{w}' contains cluster '{x}' (forbidden in {lang.name})" for x in lang.clusters if x in w]
    return {
        "canonical": canonical,
        "phonetic": "/" + ".".join("".join(sound.get(c, c) for c in canonical).split()) + "/",
        "old_italic": "".join(glyph.get(c, c) for c in canonical),
        "source_system": used,
        "tokens": tokens,
        "confidence": max(0.0, 1 - 0.15 * len(warnings)),
        "warnings": warnings,
        "apparatus": apparatus,
    }


def normalize_udf(name: str = "etruscan", system: str = "auto"):
    """A column function: text to the struct of :func:`normalize`."""
    if name not in LANGUAGES:
        raise ValueError(f"unknown language {name!r}; known: {sorted(LANGUAGES)}")

    @pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normalize(t, name, system) for t in texts])

    return run


@pandas_udf(f"struct<text:string,spans:array<{SPAN}>,warnings:array<string>>")
def leiden_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [leiden(t or "") for t in texts]
    keys = ("kind", "start", "end", "source")
    return pd.DataFrame({"text": [r[0] for r in rows], "spans": [[dict(zip(keys, s)) for s in r[1]] for r in rows], "warnings": [r[2] for r in rows]})


@pandas_udf("string")
def folded(texts: pd.Series) -> pd.Series:
    """NFC and full case folding."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


@pandas_udf("string")
def unmarked(texts: pd.Series) -> pd.Series:
    """Lower case without combining marks, by compatibility decomposition."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)))


def segments(canonical: str, spans: list[dict]) -> list[dict]:
    """Pieces of a text in order, plain or of one mark: touching spans of a kind are joined, spans within others dropped, gaps kept."""
    joined: list[list] = []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if joined and s["kind"] != "gap" and joined[-1][0] == s["kind"] and s["start"] <= joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], s["end"])
        elif not joined or s["start"] >= joined[-1][2]:
            joined.append([s["kind"], s["start"], s["end"]])
    out, at = [], 0
    for kind, a, b in joined:
        if a > at:
            out.append({"kind": "plain", "text": canonical[at:a]})
        out.append({"kind": kind, "text": canonical[a:b]})
        at = b
    return out + ([{"kind": "plain", "text": canonical[at:]}] if at < len(canonical) else [])


_ELEMENT = {"supplied": ('<supplied reason="lost">', "</supplied>"), "expansion": ("<ex>", "</ex>"), "unclear": ("<unclear>", "</unclear>"), "gap": ('<gap reason="lost"/>', "")}


def tei_text(canonical: str, spans: list[dict]) -> str:
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return "".join(a + esc(p["text"]) + b for p in segments(canonical, spans) for a, b in [_ELEMENT.get(p["kind"], ("", ""))])


@pandas_udf("string")
def tei_edition(results: pd.DataFrame) -> pd.Series:
    """The edition division of a record, from a struct (canonical, apparatus)."""
    made = [tei_text(c or "", list(a) if a is not None else []) for c, a in zip(results["canonical"], results["apparatus"])]
    return pd.Series([f'<div type="edition"><ab>{m}</ab></div>' for m in made])
