"""Quality rules as a short-circuit cascade.

Each rule looks at a block of texts and rejects some. On a sample of `SAMPLE` documents (by hash of their text) each
rule's cost (seconds a document) and selectivity (share rejected) are measured; rules then run in falling order of
rejection per cost, and a text that one rule rejects is not shown to the next. A text is kept where no rule rejects it,
so the order changes the time only, never the verdict.

Null and empty texts have no words and are rejected by the rule on few words. Repeated rows are judged alike. An empty
table gives an empty table. Other columns pass through `keep` untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from landledger.llm.shared import sample_texts, slices, text_bytes
from landledger.llm.textscan import SOLID, mix, shingles, span_hashes, word_spans

SAMPLE = 400


def _among(symbols: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(symbols.encode())] = True
    return table


SYMBOLS, SHOUTS = _among("#*$%&|<>"), _among("!")
UPPER, LETTERS = _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
CHARACTER = (np.arange(256) & 0xC0) != 0x80


class Texts:
    """A block of texts; each measure is taken once, when first asked for."""

    def __init__(self, column: pa.Array):
        self.column = column

    @cached_property
    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return text_bytes(self.column)

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return word_spans(*self.bytes, SOLID)

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each text that the table marks."""
        raw, offsets = self.bytes
        return np.diff(np.searchsorted(np.flatnonzero(table[raw]), offsets))

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.spans[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.count(SOLID & CHARACTER)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(SYMBOLS)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of each line that has a word."""
        raw, offsets = self.bytes
        breaks = np.flatnonzero(raw == 10)
        row = np.searchsorted(offsets, breaks, "right") - 1
        rows = np.concatenate([np.arange(len(offsets) - 1), row])
        starts = np.concatenate([offsets[:-1], breaks + 1])
        order = np.lexsort((starts, rows))
        rows, starts = rows[order], starts[order]
        last = np.concatenate([rows[1:] != rows[:-1], [True]]) if len(rows) else np.zeros(0, bool)
        ends = np.where(last, offsets[rows + 1], np.concatenate([starts[1:] - 1, [0]]) if len(rows) else starts)
        words = self.spans[0]
        filled = np.searchsorted(words, ends) > np.searchsorted(words, starts)
        return rows[filled], span_hashes(raw, starts[filled], ends[filled])

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=len(self.column))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        rows, hashes = self.lines
        _, first = np.unique(hashes + mix(rows), return_index=True)
        return self.n_lines - np.bincount(rows[first], minlength=len(self.column))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        raw, _ = self.bytes
        starts, ends, bounds = self.spans
        windows, at = shingles(span_hashes(raw, starts, ends), bounds, 3)
        made = np.diff(at)
        rows = np.repeat(np.arange(len(made)), made)
        keys = windows + mix(rows)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        first = (np.arange(len(keys)) - at[rows] + bounds[rows])[again]
        cover = np.zeros(len(starts) + 4, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + 3, -1)
        hit = np.cumsum(cover)[: len(starts)] > 0
        return np.diff(np.concatenate([[0], np.cumsum(hit)])[bounds])


Rule = Callable[[Texts], np.ndarray]

BASE: dict[str, Rule] = {
    "few_words": lambda t: t.n_words < 50,
    "repeats": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
}
RULES: dict[str, Rule] = {
    "symbols": lambda t: 10 * t.n_symbols > 2 * t.n_words,
    "copied_lines": lambda t: 10 * t.n_dup_lines > 5 * t.n_lines,
    "word_length": lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words),
    "shouting": lambda t: 10 * t.count(SHOUTS) > 2 * t.n_words,
    "capitals": lambda t: 2 * t.count(UPPER) > t.count(LETTERS),
}


def order_rules(docs: DataFrame, rules: dict[str, Rule], text: str = "text", sample: int = SAMPLE) -> list[str]:
    """Rule names, most rejections per second first, as measured on the sample."""
    column = pa.array(sample_texts(docs, text, sample), pa.string())
    if not len(column):
        return list(rules)
    worth = {}
    for name, rule in rules.items():
        rule(Texts(column))
        start = time.perf_counter()
        rejected = rule(Texts(column)).mean()
        worth[name] = rejected / max(time.perf_counter() - start, 1e-9)
    return sorted(rules, key=lambda name: -worth[name])


def cascade(column: pa.Array, rules: dict[str, Rule], order: list[str]) -> np.ndarray:
    """For each text, the place in `order` of the rule that rejects it, -1 where none does."""
    verdict = np.full(len(column), -1)
    alive, block = np.arange(len(column)), Texts(column)
    for at, name in enumerate(order):
        if not len(alive):
            break
        bad = rules[name](block)
        verdict[alive[bad & (verdict[alive] < 0)]] = at
        done = verdict[alive] >= 0
        if 4 * done.sum() >= len(alive):  # below a quarter it is cheaper to go on with what is measured
            alive = alive[~done]
            block = Texts(column.take(pa.array(alive)))
    return verdict


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: dict[str, Rule] | None = None) -> DataFrame:
    """Per document: the measures, whether the base rules fail, the rule that rejects it, and whether it is kept."""
    rules = rules or RULES
    order = order_rules(docs, rules, text)
    kind = docs.schema[key].dataType.simpleString()
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            block = Texts(batch.column(text))
            failed = np.logical_or.reduce([rule(block) for rule in BASE.values()])
            by = np.full(batch.num_rows, -1)
            open_ = np.flatnonzero(~failed)
            by[open_] = cascade(batch.column(text).take(pa.array(open_)), rules, order)
            names = [("base" if f else order[b] if b >= 0 else None) for f, b in zip(failed.tolist(), by.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.array(getattr(block, m), pa.int64()) for m in measures), pa.array(failed), pa.array(names, pa.string()), pa.array(~failed & (by < 0))],
                names=[key, *measures, "base_failed", "rejected_by", "kept"])

    return docs.select(key, text).mapInArrow(judge, f"{key} {kind}, " + ", ".join(f"{m} long" for m in measures) + ", base_failed boolean, rejected_by string, kept boolean")


def keep(docs: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None) -> DataFrame:
    """docs without the rows that a rule rejects; base rules take part in the cascade. Same columns."""
    rules = {**BASE, **(rules or RULES)}
    order = order_rules(docs, rules, text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(cascade(batch.column(text), rules, order) < 0))

    return docs.mapInArrow(judge, docs.schema)
