"""Benchmark decontamination with a generalised suffix automaton over the words of all items.

Items are normalised to words; the automaton of all of them is a few states per item word. A document's words are read
from left to right, carrying the state and the length of the longest match that ends here; where a word continues no
match, suffix links shorten it. A match of at least `window` words, or a whole item of fewer words, marks its words as
hit. Only runs of known words that are long enough for the shortest window can hold a match; the automaton starts at
their beginning, as it would be in its first state there.

Null and empty texts have no words and no hits; items without words give no windows; items that share an id count once;
an item without an id marks words but counts as no item. Benchmarks of more than `ITEM_WORDS` words are dealt to several
automata, each read over all documents. Columns other than id and text pass through `remove` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from landledger.llm.shared import slices, text_bytes
from landledger.llm.textscan import ALNUM, LOWER, span_hashes, word_spans

WINDOW = 13
#: Words in one automaton; a larger benchmark has more automata.
ITEM_WORDS = 2_000_000
#: A document is contaminated where hit words are at least one in so many.
COVERAGE = 20


class Automaton:
    """All factors of all items. Words are numbered by their hash's place in `vocabulary`."""

    def __init__(self, items: list[tuple[object, np.ndarray]], window: int):
        self.window = window
        words = [hashes for _, hashes in items if len(hashes)]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[tuple[int, ...], set[int]] = {}
        self.ids: list[object] = []
        numbers: dict[object, int] = {}
        sizes = set()
        for key, hashes in items:
            if not len(hashes):
                continue
            if key not in numbers:
                numbers[key] = len(self.ids)
                self.ids.append(key)
            coded = np.searchsorted(self.vocabulary, hashes).tolist()
            size = min(window, len(coded))
            sizes.add(size)
            for at in range(len(coded) - size + 1):
                self.windows.setdefault(tuple(coded[at : at + size]), set()).add(numbers[key])
            last = 0
            for word in coded:
                last = self._extend(last, word)
        self.sizes = sorted(sizes)

    def _clone(self, state: int, at: int, word: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(self.length[at] + 1)
        while at >= 0 and self.next[at].get(word) == state:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            copy = self._clone(known, last, word)
            self.link[known] = copy
            return copy
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            if self.length[target] == self.length[at] + 1:
                self.link[state] = target
            else:
                copy = self._clone(target, at, word)
                self.link[target] = copy
                self.link[state] = copy
        return state

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, word after the last, items) of each window that occurs in words."""
        state = length = 0
        step, link, lengths = self.next, self.link, self.length
        shortest = self.sizes[0]
        for at, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                length = lengths[state]
            state = step[state].get(word, 0)
            length = length + 1 if state else 0
            if length >= shortest:
                for size in self.sizes:
                    if size > length:
                        break
                    items = self.windows.get(tuple(words[at + 1 - size : at + 1]))
                    if items:
                        yield at + 1 - size, at + 1, items

    def scan(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
        """Which words are hit, and the items of each row that has any."""
        hit = np.zeros(len(hashes) + 1, np.int64)
        found: dict[int, set] = {}
        if not len(self.vocabulary) or not len(hashes):
            return hit[:-1] > 0, found
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == hashes[maybe]
        where, coded = maybe[known], place[known]
        row = np.searchsorted(bounds, where, "right") - 1
        cut = np.flatnonzero((np.diff(where) != 1) | (np.diff(row) != 0)) + 1
        begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(where)]])
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if b - a < self.sizes[0]:
                continue
            for first, stop, items in self.matches(coded[a:b].tolist()):
                hit[where[a] + first] += 1
                hit[where[a] + stop] -= 1
                found.setdefault(int(row[a]), set()).update(self.ids[k] for k in items)
        return np.cumsum(hit[:-1]) > 0, found


def automata(benchmark: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text", item_words: int = ITEM_WORDS) -> list[Automaton]:
    """Built from the benchmark's items, which are few: they are the fixed side of the search."""
    out, items, size = [], [], 0
    for item, body in benchmark.select(key, text).toLocalIterator():
        raw, offsets = text_bytes(pa.array([body], pa.string()))
        raw = LOWER[raw]
        starts, ends, _ = word_spans(raw, offsets, ALNUM)
        items.append((item, span_hashes(raw, starts, ends)))
        size += len(starts)
        if size >= item_words:
            out.append(Automaton(items, window))
            items, size = [], 0
    return [*out, Automaton(items, window)] if items else out


def _read(column: pa.Array, machines: list[Automaton]) -> tuple:
    raw, offsets = text_bytes(column)
    lower = LOWER[raw]
    starts, ends, bounds = word_spans(lower, offsets, ALNUM)
    hashes = span_hashes(lower, starts, ends)
    hit, found = np.zeros(len(hashes), bool), {}
    for machine in machines:
        own, items = machine.scan(hashes, bounds)
        hit |= own
        for row, ids in items.items():
            found.setdefault(row, set()).update(ids)
    return raw, offsets, starts, ends, bounds, hit, found


def _verdict(n_words: np.ndarray, n_hit: np.ndarray, coverage: int) -> np.ndarray:
    return (n_hit > 0) & (coverage * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: words, hit words, items that occur, the digest of their ids, and the verdict."""
    spark = docs.sparkSession
    machines = spark.sparkContext.broadcast(automata(benchmark, window))
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            *_, bounds, hit, found = _read(batch.column(text), machines.value)
            n_words = np.diff(bounds)
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[bounds])
            ids = [sorted(str(x) for x in found.get(k, ()) if x is not None) for k in range(batch.num_rows)]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(digest), pa.array(ids, pa.list_(pa.string())), pa.array(_verdict(n_words, n_hit, coverage))],
                names=[key, "n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"])

    return docs.select(key, text).mapInArrow(scan, f"{key} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, contaminated boolean")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, text: str = "text") -> DataFrame:
    """docs without contaminated rows; in the others, spans of hit words are cut out of the text. Same columns."""
    machines = docs.sparkSession.sparkContext.broadcast(automata(benchmark, window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            raw, offs, starts, ends, bounds, hit, _ = _read(batch.column(text), machines.value)
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[bounds])
            keep = ~_verdict(np.diff(bounds), n_hit, coverage)
            touched = np.flatnonzero(keep & (n_hit > 0))
            if len(touched):
                texts = batch.column(text).to_pylist()
                for k in touched.tolist():
                    body = raw[offs[k] : offs[k + 1]]
                    mark = np.zeros(len(body) + 1, np.int64)
                    own = np.flatnonzero(hit[bounds[k] : bounds[k + 1]]) + bounds[k]
                    breaks = np.flatnonzero(np.diff(own) != 1) + 1
                    for span in np.split(own, breaks):
                        mark[starts[span[0]] - offs[k]] += 1
                        mark[ends[span[-1]] - offs[k]] -= 1
                    texts[k] = body[np.cumsum(mark[:-1]) == 0].tobytes().decode()
                batch = batch.set_column(batch.schema.get_field_index(text), batch.schema.field(text), pa.array(texts, batch.schema.field(text).type))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)
