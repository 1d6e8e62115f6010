"""Language-model scores of whole texts: word unigrams, and a smoothed backoff automaton over the same words.

Tokens are the words of the lower-cased text, then one end. Corpus counts cover all n-grams of all training texts, of 1 to
`ORDER` tokens; a text begins after an end. An n-gram is a state of the automaton, and the arc that leads to it. Its
hash is made from its context's and its last word's, so a state gives its arcs. A key is 56 bits of the hash: among three
thousand million n-grams some 60 pairs are expected to share one; single words only share keys with single words.

1. One pass cuts the table into blocks of about `BLOCK_BYTES` of text: the distinct words' hashes, and texts as numbers.
2. A block's distinct n-grams, with their training counts, are dealt to buckets by ranges of the key, those of one bucket
   as one sorted list. A bucket sums its n-grams over all blocks and answers each block with the totals of its own. An
   n-gram is in a block's list once, so a frequent context is spread over all buckets. Buckets grow with the blocks.
3. A block reads its texts with the answers: an arc's probability is (count + PRIOR * shorter) / (context + PRIOR), where
   shorter is that after the failure arc, which weighs PRIOR / (context + PRIOR). At the end of the failure arcs stand
   add-half unigrams with one unknown word, the base. Probabilities sum to 1 in each state.

Nothing of the model is collected or broadcast but the number of tokens and of distinct words. Null and empty texts have
one token, the end. Without training texts N is 0 and nothing is known. Repeated rows are scored each. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.llm.scoring import BLOCK_BYTES, BUCKETS, _packed, _unpacked
from landledger.llm.shared import slices, staged, text_bytes
from landledger.llm.textscan import LOWER, SOLID, mix, span_hashes, word_spans

ORDER = 3
#: Tokens that the shorter context's distribution counts for in a state.
PRIOR = 8.0
#: Blocks whose n-grams a bucket can hold in all.
BLOCKS_A_BUCKET = 4
_END = mix(np.array([10], np.uint64))[0]
#: Bits of a 64-bit hash that a key leaves out.
_DROPPED = np.uint64(8)
_ONE = np.uint64(1)


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers, byte plane by byte plane."""
    return pa.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return planes.reshape(8, n).T.copy().view("<u8").ravel()


def _keys(hashes: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys in order, each order's place in them for each token (ends included), and row bounds.

    The lowest bit of a key is set for single words alone. Key 0 stands for an n-gram that would begin before the text.
    """
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    word = np.full(at[-1], _END)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    word[inner] = hashes[tokens]
    place = np.arange(at[-1]) - np.repeat(at[:-1], sizes + 1)
    chain, found = word, []
    for n in range(1, ORDER + 1):
        if n > 1:
            context = np.concatenate([[_END if n == 2 else 0], chain[:-1]]).astype(np.uint64)
            chain = mix(context * np.uint64(0x9E3779B97F4A7C15) + word)
        key = chain >> _DROPPED
        key = key | _ONE if n == 1 else np.where(place >= n - 2, key & ~_ONE, np.uint64(0))
        own, inverse = np.unique(key, return_inverse=True)
        found.append((own, inverse.ravel().astype(np.int32)))
    keys = np.sort(np.concatenate([own for own, _ in found]))  # not np.unique: without the inverse it hashes, which is slow here
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, [np.searchsorted(keys, own).astype(np.int32)[inverse] for own, inverse in found], at


def _blocks(docs: DataFrame, text: str, key: str, held: Column) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    schema = f"block long, words binary, keys array<{kind}>, held array<boolean>, sizes array<int>, tokens binary"

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
        raw, offsets = text_bytes(whole[text].combine_chunks() if whole[text].num_chunks != 1 else whole[text].chunk(0))
        raw = LOWER[raw]
        starts, ends, bounds = word_spans(raw, offsets, SOLID)
        hashes, tokens = np.unique(span_hashes(raw, starts, ends), return_inverse=True)
        tokens = tokens.ravel()
        order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([hashes[order].astype("<u8").tobytes()], pa.binary()), pa.array([whole[key].to_pylist()], pa.list_(whole[key].type)),
             pa.array([whole["held"].to_pylist()], pa.list_(pa.bool_())), pa.array([np.diff(bounds).astype(np.int32)], pa.list_(pa.int32())),
             pa.array([_packed(rank[tokens])], pa.binary())],
            names=["block", "words", "keys", "held", "sizes", "tokens"])

    return docs.select(key, F.coalesce(held, F.lit(False)).alias("held"), text).mapInArrow(cut, schema)


def _read(row: dict) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    sizes = np.asarray(row["sizes"], np.int64)
    return _keys(np.frombuffer(row["words"], "<u8"), _unpacked(row["tokens"], int(sizes.sum())), sizes)


def _dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, n, grams, counts): each block's n-grams of each bucket, as steps from one key to the next."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                keys, places, at = _read(row)
                training = np.repeat(~np.asarray(row["held"], bool), np.diff(at))
                counts = sum(np.bincount(p[training], minlength=len(keys)) for p in places)
                counts[keys == 0] = 0
                cuts = np.searchsorted((keys >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(cuts))
                spans = [slice(cuts[b], cuts[b + 1]) for b in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), row["block"])), pa.array(used), pa.array(np.diff(cuts)[used]),
                     pa.array([_planes(np.diff(keys[s], prepend=np.uint64(0))) for s in spans], pa.binary()), pa.array([_planes(counts[s]) for s in spans], pa.binary())],
                    names=["block", "bucket", "n", "grams", "counts"])

    return blocks.select("block", "words", "held", "sizes", "tokens").mapInArrow(deal, "block long, bucket long, n long, grams binary, counts binary")


def _summed(group: pa.Table) -> pa.Table:
    """Totals of a bucket's n-grams, answered to each block in its own order; block -1 has all tokens and distinct words."""
    sizes = group["n"].to_numpy()
    lists = [np.cumsum(_numbers(g.as_py(), n), dtype=np.uint64) for g, n in zip(group["grams"], sizes, strict=True)]
    counts = np.concatenate([_numbers(c.as_py(), n) for c, n in zip(group["counts"], sizes, strict=True)])
    keys, places = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, places, counts.astype(np.int64))
    ends = np.cumsum(sizes)
    answers = [_planes(totals[places[b - n : b]]) for n, b in zip(sizes, ends, strict=True)]
    words = totals[(keys & _ONE) == 1]
    none = [0] * len(sizes)
    return pa.table({"block": pa.array(np.append(group["block"].to_numpy(), -1)), "bucket": pa.array(np.full(len(sizes) + 1, group["bucket"][0].as_py())),
                     "n": pa.array(np.append(sizes, 0)), "totals": pa.array([*answers, None], pa.binary()),
                     "n_all": pa.array([*none, int(words.sum())], pa.int64()), "distinct": pa.array([*none, int((words > 0).sum())], pa.int64())})


def score(docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score (unigrams) and score (the automaton's)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    blocks, _ = staged(_blocks(docs, text, key, held), "blocks")
    buckets = max(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count() // BLOCKS_A_BUCKET)
    totals, _ = staged(_dealt(blocks, buckets).groupBy("bucket").applyInArrow(_summed, "block long, bucket long, n long, totals binary, n_all long, distinct long"), "totals")
    zero = F.lit(0).cast("long")
    n_all, distinct = totals.where("block = -1").agg(F.coalesce(F.sum("n_all"), zero), F.coalesce(F.sum("distinct"), zero)).first()
    known = totals.where("block >= 0").select(F.col("block").alias("of"), "bucket", "n", "totals")

    def rate(block: pa.Table, found: pa.Table) -> pa.Table:
        row = block.select(["words", "sizes", "tokens"]).to_pylist()[0]
        _, places, at = _read(row)
        found = found.sort_by("bucket")
        total = np.concatenate([_numbers(t.as_py(), n) for t, n in zip(found["totals"], found["n"].to_numpy(), strict=True)]).astype(np.float64)
        place = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))
        seen = total[places[0]]
        n_known = np.add.reduceat((seen > 0).astype(np.int64), at[:-1])
        chance = (seen + 0.5) / (n_all + 0.5 * (distinct + 1))
        base = np.add.reduceat(np.log10(chance), at[:-1])
        for n in range(2, ORDER + 1):
            before = np.concatenate([[seen[at[1] - 1] if n == 2 else 0], seen[:-1]])  # a text begins after an end
            context = np.where(place >= n - 2, before, 0)
            seen = total[places[n - 1]]
            chance = (seen + PRIOR * chance) / (context + PRIOR)
        model = np.add.reduceat(np.log10(chance), at[:-1])
        sizes = np.diff(at)
        return pa.table({key: block["keys"].combine_chunks().flatten(), "held_out": block["held"].combine_chunks().flatten(), "n_tokens": pa.array(sizes),
                         "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(len(sizes), n_all), pa.int64()), "base_score": pa.array(base), "score": pa.array(model)})

    return blocks.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        rate, f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
