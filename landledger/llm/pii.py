"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions, trained here in numpy.

Rules find e-mail addresses, IP addresses, card and phone numbers; their spans always stay. The network labels characters
(outside; begin and inside of each kind). It learns from spans that the rules' shapes mark in a bounded sample of
documents, before the number checks: it finds numbers by form and surroundings where a check digit fails. Training takes
`STEPS` batches with gradients of the CRF likelihood by backpropagation through time.

Every kind holds a digit or an `@`, so places farther than `MARGIN` from one cannot be in a span. Around the others the
text is cut into windows of `WINDOW` characters, each overlapping the next by half, all windows of a block of texts are
decoded side by side by Viterbi, and windows are reconciled over the whole text: a character takes the label of the
window in which it stands farthest from an edge. Spans of the network that touch a rule's span are dropped.

Null and empty texts have no spans. Positions count code points, the end exclusive. Repeated rows are scanned each. With
no shapes in the sample the network is left out. An empty table gives an empty table. Other columns pass through
`redact` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.llm.shared import sample_texts, slices, text_bytes

KINDS = ("email", "ip", "card", "phone")
#: Sampled documents with a digit or `@`, and characters taken around each one's marks.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 800, 1600
WINDOW, MARGIN = 64, 24
HIDDEN, EMBEDDED, STEPS, BATCH, RATE = 16, 10, 200, 48, 0.03

_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = np.zeros(256, bool)
_MARK[list(b"0123456789@")] = True


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap, from one `@` to the next, in time linear in the text."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            out.append((start, tail.end()))
            floor = tail.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(at + 1, floor))
    return out


def shapes(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of all that has a kind's form, by kind and start."""
    out = [("email", a, b, True) for a, b in emails(text)]
    out += [("ip", m.start(), m.end(), all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m[0].split("."))) for m in _IP.finditer(text)]
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            out.append(("card", match.start(), match.end(), _luhn(digits)))
    for match in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in match[0]) <= 15:
            out.append(("phone", match.start(), match.end(), True))
    return out


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    return [(k, a, b) for k, a, b, valid in shapes(text) if valid]


# -- characters and labels ---------------------------------------------------------------

N_LABELS = 1 + 2 * len(KINDS)
_SYMBOLS = "@.-+()_%:/,;=\"'#*$&|<>!?"
N_CHARS = 7 + len(_SYMBOLS)


def _codes(text: str) -> np.ndarray:
    """Class of each character: padding 0, lower, upper, digit, blank, line break, other letter, then marks each."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = np.full(128, 6, np.uint8)
    table[97:123], table[65:91], table[48:58], table[32], table[10] = 1, 2, 3, 4, 5
    for k, c in enumerate(_SYMBOLS):
        table[ord(c)] = 7 + k
    return table[np.minimum(points, 127)] * (points < 128) + 6 * (points >= 128).astype(np.uint8)


def _labels(text: str) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for kind, a, b, _ in shapes(text):
        if not out[a:b].any():
            k = KINDS.index(kind)
            out[a:b] = 2 + 2 * k
            out[a] = 1 + 2 * k
    return out


def _allowed() -> np.ndarray:
    """An inside label follows its kind's begin or inside label only."""
    ok = np.ones((N_LABELS, N_LABELS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()
#: Labels with which a window may begin: it may cut a span.
_NEVER = -1e4


def _starts(codes: np.ndarray) -> np.ndarray:
    """Starts of overlapping windows over all places near a digit or `@`."""
    marks = np.flatnonzero((codes == 3) | (codes == 7))
    if not len(marks):
        return marks
    near = np.zeros(len(codes) + 1, np.int64)
    np.add.at(near, np.maximum(marks - MARGIN, 0), 1)
    np.add.at(near, np.minimum(marks + MARGIN, len(codes)), -1)
    grid = np.unique(np.flatnonzero(np.cumsum(near[:-1]) > 0) // (WINDOW // 2))
    return np.unique(np.concatenate([grid, np.maximum(grid - 1, 0)])) * (WINDOW // 2)


def _cut(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([codes, np.zeros(WINDOW, np.uint8)])
    return padded[starts[:, None] + np.arange(WINDOW)]


# -- network -----------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBEDDED
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": normal(N_CHARS, e) * 2, "out": normal(2 * h, N_LABELS), "bias": np.zeros(N_LABELS, np.float32),
                  "jump": np.zeros((N_LABELS, N_LABELS), np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": normal(e, 4 * h), f"h{side}": normal(h, 4 * h), f"c{side}": np.zeros(4 * h, np.float32)}
            self.p[f"c{side}"][h : 2 * h] = 1

    def _pass(self, codes: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, h = len(codes), codes.shape[1], HIDDEN
        inputs = self.p["embed"] @ self.p[f"x{side}"] + self.p[f"c{side}"]  # one row per character class
        hidden, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.zeros((steps, n, h), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = inputs[codes[:, t]] + hidden @ self.p[f"h{side}"]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            bent = np.tanh(new)
            if keep:
                tape.append((t, hidden, cell, i, f, o, g, bent))
            hidden, cell = o * bent, new
            out[t] = hidden
        return out, tape

    def emissions(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        ahead, tape_f = self._pass(codes, "f", keep)
        back, tape_b = self._pass(codes, "b", keep)
        both = np.concatenate([ahead, back], axis=2)
        return both @ self.p["out"] + self.p["bias"], (both, tape_f, tape_b)

    def _jump(self) -> np.ndarray:
        return np.where(ALLOWED, self.p["jump"], _NEVER)

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the labels, and its gradient."""
        n, steps = codes.shape
        scores, (both, tape_f, tape_b) = self.emissions(codes, keep=True)
        scores, jump = scores.astype(np.float64), self._jump().astype(np.float64)
        ahead, back = np.zeros((steps, n, N_LABELS)), np.zeros((steps, n, N_LABELS))
        ahead[0] = scores[0]

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

        for t in range(1, steps):
            ahead[t] = scores[t] + lse(ahead[t - 1][:, :, None] + jump, 1)
        for t in range(steps - 2, -1, -1):
            back[t] = lse(jump + (scores[t + 1] + back[t + 1])[:, None, :], 2)
        total = lse(ahead[-1], 1)
        d_scores = np.exp(ahead + back - total[None, :, None])
        rows = np.arange(n)
        times = np.arange(steps)[:, None]
        gold = scores[times, rows, labels.T].sum(axis=0) + jump[labels[:, :-1], labels[:, 1:]].sum(axis=1)
        np.add.at(d_scores, (times, rows, labels.T), -1)
        pairs = ahead[:-1, :, :, None] + jump + (scores[1:] + back[1:])[:, :, None, :] - total[None, :, None, None]
        d_jump = np.exp(pairs).sum(axis=(0, 1))
        np.add.at(d_jump, (labels[:, :-1], labels[:, 1:]), -1)
        d = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = (d_scores / n).astype(np.float32)
        d["jump"] = np.where(ALLOWED, d_jump / n, 0).astype(np.float32)
        d["out"] = np.einsum("tnh,tnl->hl", both, flat)
        d["bias"] = flat.sum(axis=(0, 1))
        d_both = flat @ self.p["out"].T
        for side, tape, own in (("f", tape_f, d_both[:, :, :HIDDEN]), ("b", tape_b, d_both[:, :, HIDDEN:])):
            self._back(codes, side, tape, own, d)
        return float((total - gold).mean()), d

    def _back(self, codes: np.ndarray, side: str, tape: list, own: np.ndarray, d: dict[str, np.ndarray]) -> None:
        d_hidden, d_cell = np.zeros_like(own[0]), np.zeros_like(own[0])
        by_class = np.zeros((N_CHARS, 4 * HIDDEN), np.float32)
        for t, hidden, cell, i, f, o, g, bent in reversed(tape):
            dh = own[t] + d_hidden
            dc = d_cell + dh * o * (1 - bent**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            d[f"h{side}"] += hidden.T @ dz
            np.add.at(by_class, codes[:, t], dz)
            d_hidden, d_cell = dz @ self.p[f"h{side}"].T, dc * f
        d[f"c{side}"] += by_class.sum(axis=0)
        d[f"x{side}"] += self.p["embed"].T @ by_class
        d["embed"] += by_class @ self.p[f"x{side}"].T

    def fit(self, codes: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> list[float]:
        """Adam over random batches; the loss of each."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(codes), BATCH)
            loss, d = self.gradients(codes[pick], labels[pick])
            losses.append(loss)
            size = np.sqrt(sum(float((g**2).sum()) for g in d.values()))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in d.items():
                g = g * min(1.0, 5 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return losses

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best label sequence of each window."""
        scores, _ = self.emissions(codes)
        jump = self._jump()
        steps, n = scores.shape[:2]
        best, came = scores[0], np.zeros((steps, n, N_LABELS), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + jump
            came[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[t]
        out = np.zeros((n, steps), np.int8)
        out[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = came[t, np.arange(n), out[:, t]]
        return out


def train(docs: DataFrame, text: str = "text") -> Tagger | None:
    """From the rules' shapes in at most SAMPLE_TEXTS documents (by hash of the text) and SAMPLE_WINDOWS windows."""
    windows, labels = [], []
    for body in sample_texts(docs.where(F.col(text).rlike("[0-9@]")), text, SAMPLE_TEXTS):
        codes = _codes(body)
        starts = _starts(codes)[:8]
        windows.append(_cut(codes, starts))
        labels.append(_cut(_labels(body).astype(np.uint8), starts))
    if not windows:
        return None
    codes, marks = np.concatenate(windows)[:SAMPLE_WINDOWS], np.concatenate(labels)[:SAMPLE_WINDOWS].astype(np.int64)
    if not marks.any():
        return None
    tagger = Tagger()
    tagger.fit(codes, marks)
    return tagger


def _plausible(kind: str, piece: str) -> bool:
    digits = sum(c.isdigit() for c in piece)
    if kind == "email":
        return "@" in piece[1:-1]
    return (piece.count(".") == 3 and digits >= 4) if kind == "ip" else 13 <= digits <= 19 if kind == "card" else digits >= 9


def network_spans(texts: list[str], tagger: Tagger | None, batch: int = 2048) -> list[list[tuple[str, int, int]]]:
    """Spans that the network marks in each text, windows reconciled."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if tagger is None:
        return out
    coded = [_codes(t) for t in texts]
    starts = [_starts(c) for c in coded]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    if not len(owner):
        return out
    windows = np.concatenate([_cut(c, s) for c, s in zip(coded, starts, strict=True) if len(s)])
    where = np.concatenate(starts)
    labels = np.concatenate([tagger.decode(windows[a : a + batch]) for a in range(0, len(windows), batch)])
    depth = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))
    for row in np.unique(owner):
        mine = np.flatnonzero(owner == row) if len(texts) < 64 else np.arange(*np.searchsorted(owner, [row, row + 1]))
        text = texts[row]
        best, label = np.full(len(text) + WINDOW, -1), np.zeros(len(text) + WINDOW, np.int8)
        for k in mine:
            span = slice(where[k], where[k] + WINDOW)
            deeper = depth > best[span]
            best[span] = np.where(deeper, depth, best[span])
            label[span] = np.where(deeper, labels[k], label[span])
        label = label[: len(text)]
        kind = (label + 1) // 2
        begins = np.concatenate([label % 2 == 1, [False]])
        edges = np.flatnonzero(begins | (np.diff(np.concatenate([[0], kind, [0]])) != 0))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if kind[a] and _plausible(KINDS[kind[a] - 1], text[a:b]):
                out[row].append((KINDS[kind[a] - 1], a, b))
    return out


def find(column: pa.Array, tagger: Tagger | None) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """The rules' spans of each text, and all spans with the network's, by kind and start."""
    raw, offsets = text_bytes(column)
    marked = np.diff(np.searchsorted(np.flatnonzero(_MARK[raw]), offsets)) > 0
    base: list[list[tuple[str, int, int]]] = [[] for _ in range(len(column))]
    every = list(base)
    rows = np.flatnonzero(marked).tolist()
    texts = [column[k].as_py() for k in rows]
    for k, text, found in zip(rows, texts, network_spans(texts, tagger), strict=True):
        base[k] = rule_spans(text)
        taken = sorted((a, b) for _, a, b in base[k])
        more = [s for s in found if not any(a < s[2] and s[1] < b for a, b in taken)]
        every[k] = sorted([*base[k], *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, every


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame, tagger: Tagger | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the rules' counts by kind and digest, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train(docs, text))
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            base, every = find(batch.column(text), shared.value)
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in KINDS]
            digest = [hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays([batch.column(key), *counts, pa.array(digest), pa.array([_joined(s) for s in every])],
                                             names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(key, text).mapInArrow(scan, f"{key} {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def covering(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans in order of place; those that overlap as one, with the kind of the longest of them, the first on a tie."""
    out: list[tuple[str, int, int]] = []
    longest = 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not out or a >= out[-1][2]:
            out.append((kind, a, b))
            longest = b - a
            continue
        if b - a > longest:
            longest = b - a
        else:
            kind = out[-1][0]
        out[-1] = (kind, out[-1][1], max(b, out[-1][2]))
    return out


def redact(docs: DataFrame, tagger: Tagger | None = None, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets, spans that overlap by one. Same rows and columns."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train(docs, text))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            _, every = find(batch.column(text), shared.value)
            if any(every):
                texts = batch.column(text).to_pylist()
                for k, spans in enumerate(every):
                    for kind, a, b in reversed(covering(spans)):
                        texts[k] = f"{texts[k][:a]}[{kind.upper()}]{texts[k][b:]}"
                at = batch.schema.get_field_index(text)
                batch = batch.set_column(at, batch.schema.field(text), pa.array(texts, batch.schema.field(text).type))
            yield batch

    return docs.mapInArrow(scan, docs.schema)
