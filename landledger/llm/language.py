"""Language identification by cross-parsing entropy.

For each language a suffix automaton of sample text knows every string that occurs in it. A text is parsed against a
language from left to right into longest matches: a phrase goes on while the automaton has a transition and ends where
it has none. The fewer phrases a text needs per symbol, the better the language explains it; the fewest win.

Symbols are lower-case letters; what stands between letters counts as one gap. Texts are parsed in pieces of `PIECE`
symbols, all pieces of a block of texts side by side, through one table of all automata. The automata are built from at
most `SAMPLE_TEXTS` different texts and `SAMPLE_SYMBOLS` symbols a language, as many from each text.

Null texts and texts without a letter are `und` with score 0. With no labelled text all are `und`; with one language all
have score 1. Ties go to the language first in order. Labels that are null teach nothing. Repeated rows are predicted
alike. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landledger.llm.shared import slices

SAMPLE_TEXTS, TEXT_SYMBOLS, SAMPLE_SYMBOLS = 150, 4000, 24_000
#: Letters that are told apart; rarer ones are one symbol.
LETTERS = 60
PIECE = 512
GAP, RARE = 0, 1


@cache
def _folded() -> np.ndarray:
    """Each code point's lower-case letter, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts without repeated gaps, and row bounds."""
    column = pc.fill_null(column, "")
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32)
    letters = _folded()[points]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    keep = letters > 0
    if len(keep):
        keep[1:] |= (letters[:-1] > 0) & (rows[1:] == rows[:-1])
    return letters[keep], np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=len(sizes)))]).astype(np.int64)


class SuffixAutomaton:
    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in symbols:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = state
                at = link[at]
            if at >= 0:
                target = self.next[at][symbol]
                if length[target] != length[at] + 1:
                    copy = len(self.next)
                    self.next.append(dict(self.next[target]))
                    length.append(length[at] + 1)
                    link.append(link[target])
                    while at >= 0 and self.next[at].get(symbol) == target:
                        self.next[at][symbol] = copy
                        at = link[at]
                    link[target] = copy
                    target = copy
                link[state] = target
            last = state


def _letters(samples: list[np.ndarray]) -> np.ndarray:
    """LETTERS letters dealt to the languages in turn: each one's first, then each one's second, by its own counts."""
    place: dict[int, int] = {}
    for sample in samples:
        points, counts = np.unique(sample[sample > 0], return_counts=True)
        for k, letter in enumerate(points[np.argsort(-counts, kind="stable")].tolist()):
            place[letter] = min(k, place.get(letter, k))
    return np.array(sorted(place, key=lambda x: (place[x], x))[:LETTERS], np.uint32)


class Parser:
    """All languages' automata as one table: for a state and symbol, the next state and the phrases that end."""

    def __init__(self, samples: dict[str, np.ndarray]):
        self.languages = sorted(samples)
        known = _letters([samples[x] for x in self.languages])
        self.known = np.sort(known)
        self.width = len(known) + 3
        self.stay = self.width - 1
        tables, self.roots, before = [], [], 0
        for name in self.languages:
            automaton = SuffixAutomaton(self.symbols(samples[name]).tolist())
            n = len(automaton.next)
            table = np.full((n, self.width), -1, np.int64)
            for state, steps in enumerate(automaton.next):
                for symbol, target in steps.items():
                    table[state, symbol] = target
            root = table[0].copy()
            missing = table < 0
            again = np.where(root < 0, 0, root)
            # a phrase that stops costs one; a symbol the language never has costs one more, as a phrase of its own
            cost = missing * (1 + (root < 0))
            cost[0] = missing[0]
            table = (np.where(missing, again, table) + before) * 4 + cost
            table[:, self.stay] = (np.arange(n) + before) * 4
            tables.append(table)
            self.roots.append(before)
            before += n
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        lookup = np.full(0x110000, RARE, np.uint8)
        lookup[0] = GAP
        lookup[self.known] = np.arange(len(self.known)) + 2
        return lookup[points]

    def phrases(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each row in each language."""
        sizes = np.diff(bounds)
        count = -(-sizes // PIECE)
        row = np.repeat(np.arange(len(sizes)), count)
        start = bounds[row] + PIECE * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        size = np.minimum(bounds[row + 1] - start, PIECE)
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], start[order], size[order]
        symbols = self.symbols(points)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(row), axis=1)
        total = np.zeros(state.shape, np.int32)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, "left"))
            now = self.table[state[:, :live] * self.width + symbols[start[:live] + step]]
            total[:, :live] += now & 3
            state[:, :live] = now >> 2
        total += state != np.array(self.roots, np.int32)[:, None]
        out = np.zeros((len(self.languages), len(sizes)), np.int64)
        for k in range(len(self.languages)):
            out[k] = np.bincount(row, weights=total[k], minlength=len(sizes)).astype(np.int64)
        return out


def _cut(bodies: list[str]) -> np.ndarray:
    """Up to SAMPLE_SYMBOLS symbols: as many from each text, more from long ones where others are short, at a place chosen by hash."""
    parts = sorted((_points(pa.array([body]))[0] for body in bodies), key=len)
    out, left = [], SAMPLE_SYMBOLS
    for k, points in enumerate(parts):
        size = min(len(points), left // (len(parts) - k) - 1)
        if size > 0:
            at = zlib.crc32(points.tobytes()) % (len(points) - size + 1)
            out.append(np.append(points[at : at + size], np.uint32(0)))
            left -= size + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def learn(labelled: DataFrame, text: str = "text", label: str = "lang") -> Parser:
    """From labelled texts: SAMPLE_TEXTS different texts of each label (or all), SAMPLE_SYMBOLS symbols in all.

    A hash deals out the texts, another one orders them; of each a window of TEXT_SYMBOLS characters at a place chosen by
    hash is collected.
    """
    labelled = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(label).agg(F.approx_count_distinct(text)).collect()}
    if not counts:
        return Parser({})
    # half as many again, as the number of different texts is estimated
    steps = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, max(1, 2 * n // (3 * SAMPLE_TEXTS)))])
    mark = F.pmod(F.xxhash64(text), F.element_at(steps, F.col(label)).cast("long"))
    at = F.pmod(F.xxhash64(F.lit(2), text), F.greatest(F.length(text) - TEXT_SYMBOLS, F.lit(0)) + 1).cast("int") + 1
    rows = labelled.where(mark == 0).select(label, F.xxhash64(F.lit(1), text).alias("turn"), F.substring(F.col(text), at, F.lit(TEXT_SYMBOLS)).alias(text)).distinct()
    first = F.row_number().over(Window.partitionBy(label).orderBy("turn", text))
    samples: dict[str, list[str]] = {}
    for name, body in sorted(rows.withColumn("place", first).where(F.col("place") <= SAMPLE_TEXTS).select(label, text).collect()):
        samples.setdefault(name, []).append(body)
    return Parser({name: _cut(bodies) for name, bodies in samples.items()})


def predict(docs: DataFrame, parser: Parser, text: str = "text", key: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """Per document: lang_pred and score (how much fewer phrases than the next best language needs)."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    also = also or {}
    slim = docs.select(key, *[c.alias(n) for n, c in also.items()], text)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        names = np.array([*parser.languages, "und"], object)
        for batch in slices(batches, text):
            points, bounds = _points(batch.column(text))
            lettered = np.diff(bounds) > 0
            if parser.languages:
                phrases = parser.phrases(points, bounds)
                best = phrases.argmin(axis=0)
                low = phrases.min(axis=0)
                others = np.sort(phrases, axis=0)[1] if len(phrases) > 1 else low * 0 + 1
                score = np.where(lettered, 1 - low / np.maximum(others, 1) if len(phrases) > 1 else 1.0, 0.0)
                best = np.where(lettered, best, len(names) - 1)
            else:
                best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())],
                                             names=[*batch.schema.names[:-1], "lang_pred", "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(tell, f"{kinds}, lang_pred string, score double")

