"""Token ids of whole texts with the tokenizers library, each distinct word encoded once.

The byte-level pre-tokenizer never joins text across a place where a character that is not white space is followed
by white space, so ids of a text are the ids of its words, each with the blank or line break before it. Texts in
which white space follows white space, with control characters used as marks here, or with an added token of the tokenizer
(a special one, say) are encoded as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from landledger.llm.shared import slices

FIRST, GLUED = "\x01", "\x02"
#: What a text must not hold to be cut into words: marks, two white-space characters in a row, and rare white space.
UNUSUAL = r"[\x01\x02\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]{2}|[ \n]$"
#: Words kept per worker in each of two generations.
KEPT_WORDS = 200_000
_NEWLINE = re.compile(r"[\x00-\x20\x7f-\xa0]")


class Encoder:
    """Encodes texts; one for each worker, as it remembers words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one are encoded as they are.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    @staticmethod
    def _spelled(word: str) -> str:
        return word[1:] if word[:1] in (FIRST, GLUED) else word if word[:1] == "\n" else " " + word

    def _learn(self, words: list[str]) -> None:
        """Words joined by line breaks are encoded in few calls; a line break is a token of its own between them."""
        plain, alone, heads = [], [], []
        simple = len(self.line_break) == 1
        for word in words:
            if simple and word.isalnum():
                plain.append(" " + word)
                heads.append((word, False))
                continue
            spelled = self._spelled(word)
            head = spelled[:1] == "\n"
            body = spelled[1:] if head else spelled
            if not simple or _NEWLINE.search(body, 1) or not body.strip() or (body[0] < "!" and body[0] != " "):
                alone.append((word, spelled))
            else:
                plain.append(body)
                heads.append((word, head))
        mark = self.line_break[0] if self.line_break else -1
        for at in range(0, len(plain), 512):
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(plain[at : at + 512])], add_special_tokens=False)[0].ids, self.type)
            cuts = np.flatnonzero(ids == mark)
            part = heads[at : at + 512]
            assert len(cuts) == len(part) - 1
            lead = np.array([mark], self.type).tobytes()
            raw, size = ids.tobytes(), self.type.itemsize
            begin = 0
            for (word, head), cut in zip(part, [*cuts.tolist(), len(ids)], strict=True):
                self.recent[word] = (lead if head else b"") + raw[begin * size : cut * size]
                begin = cut + 1
        for word, spelled in alone:
            self.recent[word] = self._raw(spelled).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.recent) > KEPT_WORDS:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        missing = []
        for word in words:
            if word not in recent:
                known = older.get(word)
                if known is None:
                    missing.append(word)
                else:
                    recent[word] = known
        if missing:
            self._learn(missing)
        return [recent[word] for word in words]

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, each row's followed by `end`, and row bounds."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        odd = pc.match_substring_regex(column, UNUSUAL).to_numpy(zero_copy_only=False)
        for token in self.added:
            odd = odd | pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        usual = pc.if_else(pa.array(odd), "", column)
        cut = pc.replace_substring_regex(usual, r"([\pL\pN])([.,])", rf"\1 {GLUED}\2")
        cut = pc.replace_substring(cut, "\n", " \n")
        cut = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), cut, pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(cut, " ")
        coded = pc.dictionary_encode(lists.flatten())
        bounds = np.asarray(lists.offsets, np.int64)
        codes = coded.indices.to_numpy()
        spelled = self._words(coded.dictionary.to_pylist())
        sizes = np.array([len(x) for x in spelled], np.int64) // self.type.itemsize
        flat = np.frombuffer(b"".join(spelled), self.type)
        where = np.concatenate([[0], np.cumsum(sizes)])
        per = sizes[codes]
        total = np.concatenate([[0], np.cumsum(per)])
        index = np.arange(total[-1]) + np.repeat(where[codes] - total[:-1], per)
        ids = flat[index]
        rows = np.diff(total[bounds - bounds[0]])
        if not odd.any():
            at = np.concatenate([[0], np.cumsum(rows + 1)])
            out = np.full(at[-1], end, self.type)
            keep = np.ones(at[-1], bool)
            keep[at[1:] - 1] = False
            out[keep] = ids
            return out, at
        parts, begin = [], np.concatenate([[0], np.cumsum(rows)])
        for k, text in enumerate(column):
            own = self._raw(text.as_py()) if odd[k] else ids[begin[k] : begin[k + 1]]
            parts.append(np.concatenate([own, np.array([end], self.type)]))
        at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return np.concatenate(parts), at


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], text: str, path: str, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice of the batches with its ids and row bounds."""
    for batch in slices(batches, text):
        ids, at = encoder(path).encode(batch.column(text), end)
        yield batch, ids, at
