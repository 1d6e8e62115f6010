"""Language-model scores of whole texts: word unigrams, and a weighted backoff automaton over characters.

Tokens are the words of the lower-cased text, then one end. Corpus counts cover all training texts:

1. One pass cuts the table into blocks of about `BLOCK_BYTES` of text. A block keeps its distinct words, their training
   counts, and its texts as numbers of words; so a frequent word is summed in the block before anything moves.
2. Words are dealt to buckets by hash, a block's words of one bucket as one list. A bucket sums its words over all blocks
   and answers each block with the totals of that block's own words. No vocabulary is broadcast; `BUCKETS` buckets for
   each shuffle partition keep a bucket small.
3. N-grams of character classes (`ORDER` of them, 64 classes: at most 64^ORDER, whatever the corpus) are summed alike.
   With absolute discounting they become an automaton: a state for each context that occurs, an arc for each class seen
   after it, and a failure arc, weighted with the backoff mass, to the state of the next shorter context.
4. A text is read once from left to right. The state is carried along, the arc's (or failure path's and arc's)
   log-probability is added. Long texts are read in pieces side by side; as a state depends on the last ORDER - 1
   classes alone, a piece starts by reading those of the piece before it.

The probability of a byte is that of its class, given the classes before it, over the number of the class's bytes; it
sums to 1 over all token sequences. Null and empty texts have one token, the end. Without training texts N is 0, nothing
is known and all classes are alike. Repeated rows are scored each. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.llm.shared import slices, staged, text_bytes
from landledger.llm.textscan import LOWER, SOLID, span_hashes, word_spans

BLOCK_BYTES = 6 << 20
ORDER, CLASSES = 4, 64
DISCOUNT = 0.75
PIECE = 512
BUCKETS = 4
#: Tokens never hold white space, so a line break can stand for the end.
END = "\n"


def _classes() -> np.ndarray:
    """Class of each byte: letters and frequent marks alone, digits together, the rest of ASCII together, others by ranges."""
    table = np.full(256, 46, np.uint8)
    table[ord("\n")], table[ord(" ")] = 0, 1
    table[0x61:0x7B] = np.arange(26) + 2
    table[0x30:0x3A] = 28
    for k, mark in enumerate(".,!?'\"-:;()|$%&*#"):
        table[ord(mark)] = 29 + k
    table[0x80:0xC0] = 47 + (np.arange(64) >> 3)
    table[0xC0:] = 55 + (np.arange(64) >> 3)
    table[0xC3] = 63
    return table


CLASS = _classes()
#: log10 of one over the bytes of each class that a token can have; blank and end are alone in theirs.
_MEMBERS = np.bincount(CLASS[[b for b in range(256) if SOLID[b] or b in (10, 32)]], minlength=CLASSES)
WITHIN = -np.log10(np.maximum(_MEMBERS, 1))


def _stream(word_at: np.ndarray, flat: np.ndarray, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts as their words with blanks between and an end after, and row bounds. Words lie in flat."""
    sizes = np.diff(word_at)[tokens]
    rows = len(bounds) - 1
    counts = np.diff(bounds)
    row = np.repeat(np.arange(rows), counts)
    last = np.zeros(len(tokens), bool)
    last[bounds[1:][counts > 0] - 1] = True
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    own = np.repeat(word_at[tokens] - at[:-1], sizes + 1) + np.arange(at[-1])
    out = flat[np.minimum(own, max(len(flat) - 1, 0))] if len(flat) else np.zeros(at[-1], np.uint8)
    out[at[1:] - 1] = np.where(last, 10, 32)
    lengths = np.bincount(row, weights=sizes + 1, minlength=rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
    empty = np.flatnonzero(counts == 0)
    if len(empty):
        out = np.insert(out, np.concatenate([[0], np.cumsum(lengths)])[empty], 10)
        lengths[empty] = 1
    return out, np.concatenate([[0], np.cumsum(lengths)])


def _contexts(classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Code of the last ORDER classes at each place; before a text stand ends (class 0)."""
    code = classes.astype(np.uint32)
    out = code.copy()
    for back in range(1, ORDER):
        earlier = np.zeros(len(code), np.uint32)
        earlier[back:] = code[:-back]
        heads = (bounds[:-1, None] + np.arange(back))[np.arange(back) < np.diff(bounds)[:, None]]
        earlier[heads] = 0
        out += earlier << np.uint32(6 * back)
    return out


def _blocks(docs: DataFrame, text: str, key: str, held: Column) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    schema = f"block long, words array<string>, counts array<long>, grams array<int>, gram_counts array<long>, keys array<{kind}>, held array<boolean>, sizes array<int>, tokens binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, open_, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in slices(batches, text, BLOCK_BYTES):
            n = batch.column(text).nbytes
            if open_ and size + n > BLOCK_BYTES:
                yield _block(open_, (part << 32) + seen)
                open_, size, seen = [], 0, seen + 1
            open_.append(batch)
            size += n
        if open_:
            yield _block(open_, (part << 32) + seen)

    def _block(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        column = whole[text].combine_chunks() if whole[text].num_chunks != 1 else whole[text].chunk(0)
        raw, offsets = text_bytes(column)
        raw = LOWER[raw]
        starts, ends, bounds = word_spans(raw, offsets, SOLID)
        _, first, tokens = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        tokens = tokens.ravel()
        order = np.argsort(-np.bincount(tokens, minlength=len(first)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        first, tokens = first[order], rank[tokens]
        body = raw.tobytes()
        words = [body[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        out = np.asarray(whole["held"].to_pylist(), bool)
        sizes = np.diff(bounds)
        training = ~np.repeat(out, sizes)
        counts = np.bincount(tokens[training], minlength=len(words))
        word_at, flat = _flat(words)
        stream, at = _stream(word_at, flat, tokens, bounds)
        codes = _contexts(CLASS[stream], at)[~np.repeat(out, np.diff(at))]
        grams, gram_counts = np.unique(codes, return_counts=True)
        lists = [pa.array([x], pa.list_(t)) for x, t in (
            ([*words, END], pa.string()), (np.append(counts, (~out).sum()), pa.int64()), (grams.astype(np.int32), pa.int32()), (gram_counts, pa.int64()))]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *lists, pa.array([whole[key].to_pylist()], pa.list_(whole[key].type)), pa.array([out], pa.list_(pa.bool_())),
             pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())), pa.array([_packed(tokens)], pa.binary())],
            names=["block", "words", "counts", "grams", "gram_counts", "keys", "held", "sizes", "tokens"])

    return docs.select(key, F.coalesce(held, F.lit(False)).alias("held"), text).mapInArrow(cut, schema)


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers, byte plane by byte plane: the upper planes are nearly empty."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return planes.reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def _bucket_order(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words' places bucket by bucket, and where each bucket begins (one more entry than buckets)."""
    at, flat = _flat(words)
    filled = np.flatnonzero(np.diff(at) > 0)
    bucket = np.zeros(len(words), np.int64)
    bucket[filled] = (span_hashes(flat, at[:-1][filled], at[1:][filled]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, words, counts): each block's words of each bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, counts = batch.column("words")[k].values, batch.column("counts")[k].values
                order, at = _bucket_order(words.to_pylist(), buckets)
                used = np.flatnonzero(np.diff(at))
                bounds = pa.array(np.append(at[used], at[-1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), batch.column("block")[k].as_py())), pa.array(used),
                     pa.ListArray.from_arrays(bounds, words.take(pa.array(order))), pa.ListArray.from_arrays(bounds, counts.take(pa.array(order)))],
                    names=["block", "bucket", "words", "counts"])

    return blocks.select("block", "words", "counts").mapInArrow(deal, "block long, bucket long, words array<string>, counts array<long>")


def _summed(group: pa.Table) -> pa.Table:
    """Totals of a bucket's words, answered to each block in its own order; block -1 has all tokens and distinct words."""
    lists = group["words"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    places = coded.indices.to_numpy()
    counts = group["counts"].combine_chunks().flatten().to_numpy()
    totals = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(totals, places, counts)
    lengths = lists.value_lengths().to_numpy()
    answers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(totals[places]))
    summary = pa.array([[int(totals.sum()), int((totals > 0).sum())]], pa.list_(pa.int64()))
    n = group.num_rows
    return pa.table({"block": pa.array(np.append(group["block"].to_numpy(), -1)), "bucket": pa.array(np.full(n + 1, group["bucket"][0].as_py())),
                     "totals": pa.concat_arrays([answers, summary])})


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    coded = [w.encode() for w in words]
    return np.concatenate([[0], np.cumsum([len(w) for w in coded])]).astype(np.int64), np.frombuffer(b"".join(coded), np.uint8)


class BackoffAutomaton:
    """step[state * CLASSES + class]: next state; weight: log10 probability of the class, failure arcs followed."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        counts = counts.astype(np.float64)
        # the state of the empty context: add-half class frequencies
        unigrams = np.bincount(grams & (CLASSES - 1), weights=counts, minlength=CLASSES)
        rows = ((unigrams + 0.5) / (unigrams.sum() + 0.5 * CLASSES))[None, :]
        probability = [rows]
        contexts = [np.zeros(1, np.int64)]
        for n in range(1, ORDER):
            tail = grams.astype(np.int64) & (CLASSES ** (n + 1) - 1)
            arcs, inverse = np.unique(tail, return_inverse=True)
            seen = np.bincount(inverse.ravel(), weights=counts, minlength=len(arcs))
            context, of = np.unique(arcs >> 6, return_inverse=True)
            of = of.ravel()
            total = np.bincount(of, weights=seen, minlength=len(context))
            kinds = np.bincount(of, minlength=len(context))
            shorter = np.searchsorted(contexts[-1], context & (CLASSES ** (n - 1) - 1)) if n > 1 else np.zeros(len(context), np.int64)
            failure = DISCOUNT * kinds / np.maximum(total, 1)
            rows = failure[:, None] * probability[-1][shorter]
            rows[of, arcs & (CLASSES - 1)] += (seen - DISCOUNT) / total[of]
            probability.append(rows)
            contexts.append(context)
        before = np.cumsum([0, *map(len, contexts)])
        self.weight = np.log10(np.concatenate(probability)).ravel()
        steps = []
        for n, context in enumerate(contexts):
            longer = (context[:, None] << 6) + np.arange(CLASSES)
            target = np.zeros(longer.shape, np.int64)
            found = np.zeros(longer.shape, bool)
            for m in range(min(n + 1, ORDER - 1), 0, -1):  # the longest context that occurs
                if not len(contexts[m]):
                    continue
                wanted = longer & (CLASSES**m - 1)
                place = np.minimum(np.searchsorted(contexts[m], wanted), len(contexts[m]) - 1)
                hit = ~found & (contexts[m][place] == wanted)
                target[hit] = before[m] + place[hit]
                found |= hit
            steps.append(target)
        self.step = np.concatenate(steps).astype(np.int32).ravel()

    def read(self, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each row's classes, after a start of ends."""
        sizes = np.diff(bounds)
        count = -(-sizes // PIECE)
        row = np.repeat(np.arange(len(sizes)), count)
        start = bounds[row] + PIECE * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        size = np.minimum(bounds[row + 1] - start, PIECE)
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], start[order], size[order]
        state = np.zeros(len(row), np.int32)
        for back in range(ORDER - 1, 0, -1):
            inside = start - back >= bounds[row]
            state = self.step[state * CLASSES + np.where(inside, classes[np.maximum(start - back, 0)], 0)]
        total = np.zeros(len(row))
        for at in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -at, "left"))
            arc = state[:live] * CLASSES + classes[start[:live] + at]
            total[:live] += self.weight[arc]
            state[:live] = self.step[arc]
        return np.bincount(row, weights=total, minlength=len(sizes))


def score(docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score (unigrams) and score (the automaton's)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    blocks, _ = staged(_blocks(docs, text, key, held), "blocks")
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    totals, _ = staged(_dealt(blocks, buckets).groupBy("bucket").applyInArrow(_summed, "block long, bucket long, totals array<long>"), "totals")
    zero = F.lit(0).cast("long")
    n_all, distinct = totals.where("block = -1").agg(F.coalesce(F.sum(F.get("totals", F.lit(0))), zero), F.coalesce(F.sum(F.get("totals", F.lit(1))), zero)).first()
    # at most CLASSES^ORDER rows
    grams = blocks.select(F.explode(F.arrays_zip("grams", "gram_counts")).alias("g")).groupBy("g.grams").agg(F.sum("g.gram_counts").alias("n")).orderBy("grams").toPandas()
    machine = spark.sparkContext.broadcast(BackoffAutomaton(grams["grams"].to_numpy(np.int64), grams["n"].to_numpy(np.int64)))
    known = totals.where("block >= 0").select(F.col("block").alias("of"), "bucket", "totals")

    def rate(block: pa.Table, found: pa.Table) -> pa.Table:
        get = lambda name: np.asarray(block[name].combine_chunks().flatten())
        spelled = block["words"].combine_chunks().flatten().to_pylist()
        count = np.zeros(len(spelled), np.int64)
        order, _ = _bucket_order(spelled, buckets)
        count[order] = found.sort_by("bucket")["totals"].combine_chunks().flatten().to_numpy()
        sizes = get("sizes").astype(np.int64)
        tokens = _unpacked(block["tokens"][0].as_py(), int(sizes.sum()))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        row = np.repeat(np.arange(len(sizes)), sizes)
        logs = np.log10((count + 0.5) / (n_all + 0.5 * (distinct + 1)))
        base = np.bincount(row, weights=logs[tokens], minlength=len(sizes)) + logs[-1]
        n_known = np.bincount(row, weights=count[tokens] > 0, minlength=len(sizes)).astype(np.int64) + int(count[-1] > 0)
        word_at, flat = _flat(spelled[:-1])
        stream, at = _stream(word_at, flat, tokens, bounds)
        classes = CLASS[stream]
        within = np.concatenate([[0], np.cumsum(WITHIN[classes])])
        model = machine.value.read(classes, at) + within[at[1:]] - within[at[:-1]]
        keys = block["keys"].combine_chunks().flatten()
        held_out = block["held"].combine_chunks().flatten()
        return pa.table({key: keys, "held_out": held_out, "n_tokens": pa.array(sizes + 1), "n_known": pa.array(n_known),
                         "train_tokens": pa.array(np.full(len(sizes), n_all), pa.int64()), "base_score": pa.array(base), "score": pa.array(model)})

    return blocks.select("block", "words", "keys", "held", "sizes", "tokens").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        rate, f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
