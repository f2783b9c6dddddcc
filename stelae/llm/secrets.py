"""Secrets by a character convolutional network over every candidate and its surroundings.

Candidates are the findings of three base rules (assign, access, hex) and, beyond them, every token of twelve characters
or more that has letters and digits, host names and file names among them, and every value after a cue (key, auth,
pass and the like before a colon or an equals sign), whatever it is made of: most are no secrets, and the network says
which are. A network in numpy reads each candidate whole with the characters around it: learned filters of width 5, pooled
apart over the candidate and over its surroundings, then a logistic layer. It is trained on labelled findings: generated
credentials and look-alikes of many kinds, and a bounded sample of the corpus's base findings; what the base rules miss in
the corpus has no label, as it may be a secret. Scores are calibrated (Platt) on findings left out of the fit, and the
threshold is the highest that keeps the required recall on them. Base findings always stay; the network decides on the others.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_texts

#: In order: base kinds, then the one that the network adds.
KINDS = ("assign", "access", "hex", "token")
BASE = 3
AROUND = 32
SAMPLE_DOCS = 2000
#: Characters of a finding that training reads at most, and of findings that are scored at once.
LONGEST, PIECE = 1024, 1 << 15
#: The recall that the threshold keeps on findings left out of the fit, of all and of each generated kind.
RECALL, KIND_RECALL = 0.98, 0.96


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + f"|{_either('api')}_?{_either('key')}"
_assign_re = re.compile(rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_access_re = re.compile(r"AKIA[A-Z0-9]+")
_hex_re = re.compile(r"[0-9a-f]{32,}")
_long_re = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
#: Words before a colon or an equals sign that make what follows a candidate.
CUES = ("auth", "bearer", "credential", "credentials", "creds", "key", "pass", "passcode", "passphrase", "password", "pwd", "secret", "token")
_value_re = re.compile(rf"""(?<![A-Za-z])(?:{"|".join(map(_either, sorted(CUES, key=len, reverse=True)))})["']?\x20*[:=]\x20*["']?([^\s"'`<>|,;]{{6,}})""")
_cue_re = re.compile(r"[:=]")

Span = tuple[int, int, int]  # start, kind, end


def base_findings(text: str) -> list[Span]:
    out = []
    if _cue_re.search(text):
        out += [(m.start(), 0, m.end()) for m in _assign_re.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in _access_re.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _hex_re.finditer(text)]  # a whole run of 32 or more: the same as runs, filtered
    return sorted(out)


def other_candidates(text: str, base: list[Span]) -> list[Span]:
    """Mixed tokens and values after cues that touch no base finding and no candidate before them. All come in order of start, so one sweep compares them."""
    found = [m.span() for m in _long_re.finditer(text) if any(c in string.digits for c in m[0]) and any(c in string.ascii_letters for c in m[0])]
    if _cue_re.search(text):
        found = sorted({*found, *(m.span(1) for m in _value_re.finditer(text))}, key=lambda s: (s[0], -s[1]))
    out, k, reach = [], 0, 0
    for a, b in found:
        while k < len(base) and base[k][0] < b:
            reach, k = max(reach, base[k][2]), k + 1
        if reach <= a:
            out.append((a, 3, b))
            reach = b
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii", "replace"), np.uint8)


class Network:
    DIM, WIDTH, FILTERS = 6, 5, 16

    def __init__(self, seed: int = 5):
        rng, f = np.random.default_rng(seed), np.float32
        d, w, n = self.DIM, self.WIDTH, self.FILTERS
        self.p = {
            "embed": rng.normal(0, 0.5, (128, d)).astype(f),
            "conv": rng.normal(0, 1 / np.sqrt(d * w), (w * d, n)).astype(f),
            "bias": np.zeros(n, f),
            "top": rng.normal(0, 0.1, 3 * n).astype(f),
            "shift": np.zeros(1, f),
        }
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, findings: list[tuple[str, str, str]]):
        """findings: (before, candidate, after). Windows of the candidate are those that begin in it."""
        w, d, n = self.WIDTH, self.DIM, self.FILTERS
        rows = [self._row(*f) for f in findings]
        at = np.r_[0, np.cumsum([len(r) for r in rows])]
        flat = np.concatenate(rows)
        e = self.p["embed"][flat]
        windows = np.lib.stride_tricks.sliding_window_view(e, w, axis=0).transpose(0, 2, 1).reshape(-1, w * d)
        y = np.maximum(windows @ self.p["conv"] + self.p["bias"], 0)
        y = np.concatenate([y, np.zeros((w, n), np.float32)])
        start = at[:-1] + np.array([w + len(a[-AROUND:]) for a, _, _ in findings])
        stop = start + np.array([max(1, len(x)) for _, x, _ in findings])
        inside = np.maximum.reduceat(y, np.stack([start, stop], 1).ravel(), axis=0)[::2]
        mean = np.add.reduceat(y, np.stack([start, stop], 1).ravel(), axis=0)[::2] / (stop - start)[:, None]
        before = np.maximum.reduceat(y, np.stack([at[:-1], start], 1).ravel(), axis=0)[::2]
        return flat, windows, y, at[:-1], start, stop, np.concatenate([inside, mean, before], axis=1).astype(np.float32)

    def _row(self, before: str, found: str, after: str) -> np.ndarray:
        return _codes("\x02" * self.WIDTH + before[-AROUND:] + found + after[:AROUND] + "\x03" * self.WIDTH) & 127

    def _pooled(self, before: str, found: str, after: str) -> np.ndarray:
        """The features of one long finding, as of :meth:`_forward`, in pieces of PIECE windows: memory does not grow with it but for its text."""
        w, flat = self.WIDTH, self._row(before, found, after)
        start = w + len(before[-AROUND:])
        stop = start + max(1, len(found))
        inside, mean, ahead = (np.zeros(self.FILTERS) for _ in range(3))  # responses are never negative
        for at in range(0, len(flat) - w + 1, PIECE):
            e = self.p["embed"][flat[at : at + PIECE + w - 1]]
            windows = np.lib.stride_tricks.sliding_window_view(e, w, axis=0).transpose(0, 2, 1).reshape(-1, w * self.DIM)
            y = np.maximum(windows @ self.p["conv"] + self.p["bias"], 0)
            own, lead = y[max(0, start - at) : max(0, stop - at)], y[: max(0, start - at)]
            if len(own):
                inside, mean = np.maximum(inside, own.max(axis=0)), mean + own.sum(axis=0, dtype=np.float64)
            if len(lead):
                ahead = np.maximum(ahead, lead.max(axis=0))
        return np.concatenate([inside, mean / (stop - start), ahead]).astype(np.float32)

    def raw(self, findings) -> np.ndarray:
        """Scores before calibration, of findings in batches of about PIECE characters; longer ones are pooled in pieces."""
        out, batch, size = np.empty(len(findings)), [], 0
        for k, f in enumerate(findings):
            if len(f[1]) > PIECE:
                out[k] = (self._pooled(*f) @ self.p["top"] + self.p["shift"])[0]
                continue
            batch.append(k)
            size += len(f[1]) + 2 * AROUND
            if size > PIECE:
                out[batch] = self._forward([findings[i] for i in batch])[-1] @ self.p["top"] + self.p["shift"]
                batch, size = [], 0
        if batch:
            out[batch] = self._forward([findings[i] for i in batch])[-1] @ self.p["top"] + self.p["shift"]
        return out

    def score(self, findings) -> np.ndarray:
        z = self.slope * self.raw(findings) + self.offset if findings else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _step(self, findings, labels):
        p, n, d, w = self.p, self.FILTERS, self.DIM, self.WIDTH
        flat, windows, y, first, start, stop, x = self._forward(findings)
        prob = 1 / (1 + np.exp(-np.clip(x @ p["top"] + p["shift"], -30, 30)))
        g = ((prob - labels) / len(labels)).astype(np.float32)
        gx = g[:, None] * p["top"]
        gy = np.zeros_like(y)
        for i in range(len(findings)):
            part = y[start[i] : stop[i]]
            gy[start[i] + part.argmax(axis=0), np.arange(n)] += gx[i, :n]
            gy[start[i] : stop[i]] += gx[i, n : 2 * n] / (stop[i] - start[i])
            gy[first[i] + y[first[i] : start[i]].argmax(axis=0), np.arange(n)] += gx[i, 2 * n :]
        gy = (gy * (y > 0))[: len(windows)]
        ge = (gy @ p["conv"].T).reshape(-1, w, d)
        seen = np.lib.stride_tricks.sliding_window_view(flat, w)
        cell = (seen.reshape(-1, 1).astype(np.int64) * d + np.arange(d)).ravel()
        embed = np.bincount(cell, weights=ge.ravel(), minlength=128 * d).reshape(128, d).astype(np.float32)
        return {"top": x.T @ g + 1e-4 * p["top"], "shift": g.sum(keepdims=True), "conv": windows.T @ gy, "bias": gy.sum(axis=0), "embed": embed}

    def fit(self, findings, labels, rounds: int = 6, batch: int = 64, rate: float = 0.01, recall: float = RECALL, seed: int = 11) -> "Network":
        """Four fifths fit the weights (Adam); of the rest, one half calibrates the score and the other sets the threshold."""
        labels = np.asarray(labels, np.float32)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(findings))
        fit, rest = order[len(order) // 5 :], order[: len(order) // 5]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(rounds):
            fit = rng.permutation(fit)
            for at in range(0, len(fit), batch):
                rows = fit[at : at + batch]
                step += 1
                for k, g in self._step([findings[i] for i in rows], labels[rows]).items():
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.99 * s[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        half, rest = rest[::2], rest[1::2]
        self.calibrate(self.raw([findings[i] for i in half]), labels[half])
        found = np.sort(self.score([findings[i] for i in rest])[labels[rest] == 1])
        self.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 0.5
        return self

    def constrain(self, kinds: list[tuple[str, tuple[str, str, str], int]], recall: float = KIND_RECALL) -> "Network":
        """Set the threshold to the highest that keeps the recall of every kind of ``kinds``, findings left out of the fit: base findings,
        which stay in any case and are the easy ones, have no say."""
        by: dict[str, list[float]] = {}
        for (kind, _, label), p in zip(kinds, self.score([f for _, f, _ in kinds])):
            if label:
                by.setdefault(kind, []).append(float(p))
        self.threshold = min(sorted(v)[int((1 - recall) * len(v))] for v in by.values())
        return self

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Platt: slope and offset of a logistic fit of the labels on the raw scores, by Newton steps with a small penalty."""
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r, v = p - y, np.maximum(p * (1 - p), 1e-6)
            h = np.array([[np.sum(v * z * z) + 1.0, np.sum(v * z)], [np.sum(v * z), np.sum(v) + 1.0]])
            da, db = np.linalg.solve(h, [np.sum(r * z) + (a - 1), np.sum(r)])
            a, b = a - da, b - db
        self.slope, self.offset = float(max(a, 1e-3)), float(b)


_LETTERS = "etaoinshrdlucmfy" * 3 + "pgwbvkxjqz" + "éóñüßç"


def _some(rng: random.Random, alphabet: str, a: int, b: int) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(a, b)))


def _word(rng: random.Random) -> str:
    return _some(rng, _LETTERS, 2, 9)


def _label(rng: random.Random) -> str:
    return _some(rng, "etaoinshrdlucmfymailexp", 2, 9)


_ALNUM, _HEX, _MARKS = string.ascii_letters + string.digits, "0123456789abcdef", "!@#$%^&*"
#: Kinds of credentials that are generated, none of which a base rule finds where it stands, and whether one only counts behind a cue.
SECRET_KINDS = {
    "random": (lambda r: _some(r, _ALNUM, 20, 48), False),
    "base64": (lambda r: _some(r, _ALNUM + "+/", 32, 60) + "=" * r.randint(0, 2), False),
    "vendor": (lambda r: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "AIza"]) + _some(r, _ALNUM, 20, 40), False),
    "short hex": (lambda r: _some(r, _HEX, 16, 31), True),
    "short": (lambda r: _some(r, _ALNUM, 12, 19), True),
    "password": (lambda r: _some(r, string.ascii_letters, 3, 6) + _some(r, _MARKS, 1, 2) + _some(r, string.digits, 1, 3) + _some(r, _ALNUM + _MARKS, 2, 6), True),
}
_OPEN_CUES = ["", "see ", "use ", "export K=", "Authorization: Bearer ", "with "]
_CUES = ["key: ", "key = \"", "auth: ", "auth=", "pwd: ", "pwd=", "pass: ", "passcode: ", "passphrase = ", "credential: ", "creds: ", "bearer: "]
#: Tokens of like length that are none, and what stands behind a cue in prose.
OTHER_KINDS = {
    "name": lambda r: "_".join(_word(r) for _ in range(4)) + "_" + str(r.randint(1, 99)),
    "slug": lambda r: "-".join(_word(r) for _ in range(5)) + "-" + str(r.randint(1990, 2030)),
    "path": lambda r: "/".join(_word(r) for _ in range(5)) + "/" + str(r.randint(1, 999)),
    "camel": lambda r: "".join(_word(r).capitalize() for _ in range(4)) + str(r.randint(1, 9)),
    "uuid": lambda r: "-".join(_some(r, _HEX, n, n) for n in (8, 4, 4, 4, 12)),
    "time": lambda r: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}Z",
    "line": lambda r: _some(r, "=-_", 18, 40) + _some(r, string.digits + "ab", 2, 3),
    "host": lambda r: f"{_label(r)}{r.randint(1, 99)}.{_label(r)}.{r.choice(['com', 'org', 'net', 'de'])}",
    "host of a mail address": lambda r: f"{r.choice(['', 'mail', 'mx', 'post', _label(r)])}{r.randint(1, 99)}.{r.choice(['example', _label(r)])}.{r.choice(['com', 'org', 'net', 'de'])}",
    "page": lambda r: f"//{r.choice(['', 'www.'])}{_word(r)}{r.randint(1, 99)}.{_word(r)}.{r.choice(['com', 'org', 'fr'])}/{_word(r)}/{r.randint(1, 999)}",
    "file": lambda r: f"{_word(r)}_{_word(r)}{r.randint(1, 9999)}.{r.choice(['jpg', 'pdf', 'txt', 'tar.gz'])}",
    "version": lambda r: f"{_word(r)}-{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}-rc{r.randint(1, 9)}",
    "count": lambda r: f"{r.randint(1, 9999)}{_word(r)}-{r.randint(1, 9999)}{_word(r)}",
}


def generated_kinds(count: int = 3200, seed: int = 17) -> list[tuple[str, tuple[str, str, str], int]]:
    """(kind, finding, label) made by rule: credentials in the settings where they occur, and tokens that are none in theirs, in turn."""
    rng = random.Random(seed)
    token = lambda: rng.choice([m for m, _ in SECRET_KINDS.values()] + list(OTHER_KINDS.values()))(rng)
    said = lambda: rng.choice([_word] * 12 + [lambda r: _word(r).capitalize(), lambda r: str(r.randint(0, 9999)), lambda r: token()])(rng)
    prose = lambda k: rng.choice([" "] * 8 + [", ", "; ", "\n"]).join(said() for _ in range(k))
    out = []
    for i in range(count):
        before, after = prose(rng.randint(2, 5)) + " ", rng.choice([" ", ". ", ".\n", "\n"]) + prose(rng.randint(2, 5))
        if i % 2:
            kind = rng.choice(list(SECRET_KINDS))
            make, cued = SECRET_KINDS[kind]
            before, value = before + rng.choice(_CUES if cued else _CUES + _OPEN_CUES), make(rng)
        elif rng.random() < 0.25:
            kind, value, before = "word behind a cue", _some(rng, _LETTERS, 6, 11), before + rng.choice(_CUES)
        else:
            kind = "host of a mail address" if rng.random() < 0.2 else rng.choice(list(OTHER_KINDS))
            name = _some(rng, _LETTERS + ".", 1, 8) + rng.choice(["", ".", str(rng.randint(1, 99)), f".{rng.randint(1, 99)}"])
            lead = name + "@" if "mail" in kind else rng.choice(["", "see ", "file ", "id ", "/", "version ", "https://", "https://www.", "http://", "("])
            value, before = OTHER_KINDS[kind](rng), before + lead
        out.append((kind, (before[-AROUND:], value, after[:AROUND]), i % 2))
    return out


def generated(count: int = 3200, seed: int = 17) -> tuple[list[tuple[str, str, str]], list[int]]:
    """The findings and labels of :func:`generated_kinds`."""
    _, found, labels = zip(*generated_kinds(count, seed))
    return list(found), list(labels)


def around(text: str, span: Span) -> tuple[str, str, str]:
    a, _, b = span
    return text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, recall: float = RECALL) -> Network:
    """Fit on generated findings and on the base findings of at most ``sample_docs`` documents (by hash of doc_id), which are secrets by rule.

    The findings are made where the documents are; at most 4 of a document, none over LONGEST characters, and 4,000 in
    all, come to the driver.
    """
    few = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()

    def rows(ids, texts):
        out = {"doc_id": [], "before": [], "found": [], "after": []}
        for i, t in zip(ids, texts):
            t = t.decode()
            for s in base_findings(t)[:4]:
                if s[2] - s[0] <= LONGEST:
                    for key, x in zip(("before", "found", "after"), around(t, s)):
                        out[key].append(x)
                    out["doc_id"].append(i)
        return out

    kept = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most sample_docs ids
    schema = f"doc_id {id_type(docs).simpleString()}, before string, found string, after string"
    got = map_texts(kept, rows, schema).orderBy(F.xxhash64("doc_id", "before", "found"), "before", "found").limit(4000).collect()
    findings, labels = generated()
    network = Network().fit(findings + [(r.before, r.found, r.after) for r in got], labels + [1] * len(got), recall=recall)
    return network.constrain(generated_kinds(seed=23))


def secrets_in(text: str, network: Network) -> list[tuple[Span, float]]:
    """All findings with their scores: base ones always, others from the network's threshold on."""
    base = base_findings(text)
    spans = sorted(base + other_candidates(text, base))
    scores = network.score([around(text, s) for s in spans])
    return [(s, float(p)) for s, p in zip(spans, scores) if s[1] < BASE or p >= network.threshold]


def findings(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings): an array of (kind, start_at, end_at, score) per row, in code points, end exclusive; null and empty texts have none."""

    def rows(ids, texts):
        found = [[{"kind": KINDS[k], "start_at": a, "end_at": b, "score": p} for (a, k, b), p in secrets_in(t.decode(), network)] for t in texts]
        return {"doc_id": ids, "findings": found}

    schema = f"doc_id {id_type(docs, id_col).simpleString()}, findings array<struct<kind: string, start_at: int, end_at: int, score: double>>"
    return map_texts(docs, rows, schema, id_col, text_col)


def redacted(text: str, network: Network, mark: str = "<secret>") -> str:
    out, at = [], 0
    for (a, _, b), _ in secrets_in(text, network):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def digests(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_rejected, scores): :func:`findings` with counts, a digest of the base
    kinds and all spans joined; the candidates that the network rejected, and the score of each span, in the same order."""

    def rows(ids, texts):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_added", "n_rejected", "base_sha256", "spans", "scores")}
        for t in texts:
            t = t.decode()
            scored = secrets_in(t, network)
            found = [s for s, _ in scored]
            for k, name in enumerate(("n_assign", "n_access", "n_hex", "n_added")):
                out[name].append(sum(s[1] == k for s in found))
            base = [s for s in found if s[1] < BASE]
            out["n_rejected"].append(len(other_candidates(t, base)) - out["n_added"][-1])
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(found))
            out["scores"].append(",".join(f"{p:.3f}" for _, p in scored))
        return {"doc_id": ids} | out

    counts = ", ".join(f"{c} bigint" for c in ("n_assign", "n_access", "n_hex"))
    schema = f"doc_id {id_type(docs, id_col).simpleString()}, {counts}, base_sha256 string, spans string, n_added bigint, n_rejected bigint, scores string"
    return map_texts(docs, rows, schema, id_col, text_col)
