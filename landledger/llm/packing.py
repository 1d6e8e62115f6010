"""Best-fit packing of documents into sequences of fixed capacity.

1. Each document's ids (and an end id) are cut into pieces of at most `capacity`; pieces are written once.
2. Pieces are range-sorted by length and ranked within their length, so that equal pieces differ by rank alone.
3. Bulk-synchronous best fit. Pieces of one length act as one run of ranks, sequences opened together and filled alike
   as one run of numbers. A superstep takes the longest lengths first: each run of pieces goes to its successor among
   the gaps (the smallest gap that holds it), the lower ranks first where there are more pieces than gaps; those gaps
   shrink, and the rest of the run goes on to the next successor, then to new sequences. There are at most `capacity`
   lengths and as many gaps, so the sweep's state does not grow with the data.
4. Each piece finds its sequence and place by a search for its rank in the runs of its length, in parallel.

The result is that of best-fit decreasing, with no pass over single documents in one place.

Null texts are empty and have one piece, the end id. Repeated rows are packed each on its own. An empty table gives an
empty table. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.llm.shared import staged
from landledger.llm.tokens import encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANKED = PIECES + ", part int, nth long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, path: str, capacity: int, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: only documents over `capacity` are cut; their first piece is the shorter one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, at in encoded(batches, text, path, end):
            size = np.diff(at)
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = size - (count - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            wide = ids.astype("<u4")
            begin = at[row] + start
            crc = [zlib.crc32(wide[b : b + n].data) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(cut, PIECES)


def sweep(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of pieces (length, first rank) with the first sequence number and the offset each goes to."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first number, how many)
    runs: list[tuple[int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            gap = next((g for g in range(length, capacity) if gaps.get(g)), None)
            if gap is None:
                # no sequence holds it: open as many as the run fills, and let it fill them
                fits = capacity // length
                new = -(-left // fits)
                gaps.setdefault(capacity - length, []).append((opened, new))
                runs.append((length, rank, opened, 0))
                opened, rank, left = opened + new, rank + new, left - new
                continue
            first, many = gaps[gap].pop()
            used = min(many, left)
            if used < many:
                gaps[gap].append((first + used, many - used))
            runs.append((length, rank, first, capacity - gap))
            if gap > length:
                gaps.setdefault(gap - length, []).append((first, used))
            rank, left = rank + used, left - used
    names = ("length", "rank", "sequence", "offset")
    table = np.array(runs, np.int64).reshape(-1, 4)
    order = np.lexsort((table[:, 1], table[:, 0]))
    return {name: table[order, k] for k, name in enumerate(names)}


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    spark = docs.sparkSession
    cut, folder = staged(pieces(docs, path, capacity, end, text, key), "pieces")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            change = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
            run_start = np.flatnonzero(change)
            within = np.arange(len(ordered)) - np.repeat(run_start, np.diff(np.concatenate([run_start, [len(ordered)]])))
            nth = np.empty(len(length), np.int64)
            nth[order] = within + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(length), part), pa.int32()), pa.array(nth)],
                names=[*batch.schema.names, "part", "nth"],
            )

    ranked, _ = staged(cut.repartitionByRange("length", "doc_id", "piece", "ids_crc32").mapInArrow(rank, RANKED), "ranked", folder)
    # A range-sorted length lies in neighbouring parts: at most (parts + capacity) rows, whatever the input.
    shares = ranked.groupBy("length", "part").count().orderBy("length", "part").collect()
    counts: dict[int, int] = {}
    share_rank = {}
    for share in shares:
        share_rank[share["length"], share["part"]] = counts.get(share["length"], 0)
        counts[share["length"]] = counts.get(share["length"], 0) + share["count"]
    plan = spark.sparkContext.broadcast((sweep(counts, capacity), share_rank))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, before = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, part, nth = (batch.column(x).to_numpy() for x in ("length", "part", "nth"))
            both, where = np.unique(np.stack([length, part.astype(np.int64)]), axis=1, return_inverse=True)
            base = np.array([before[int(n), int(p)] for n, p in both.T], np.int64)
            own = nth + base[where.ravel()]
            at = np.empty(len(own), np.int64)
            for n in np.unique(length):
                lo, hi = np.searchsorted(runs["length"], [n, n + 1])
                mine = length == n
                at[mine] = lo + np.searchsorted(runs["rank"][lo:hi], own[mine], "right") - 1
            sequence = runs["sequence"][at] + own - runs["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(runs["offset"][at])],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PACKED)


