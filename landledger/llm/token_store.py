"""Token ids in binary shards, with a minimal perfect hash index from document key to place.

Shard file (little endian): 8 bytes magic, uint32 bytes per id, uint32 zero, the ids of all its documents end to end,
then a uint64 length per document, then a uint64 number of documents. Shards hold documents in ascending key order.

Index: keys are dealt to buckets by hash. A bucket's keys are placed by a cascade of bit maps (a key takes the first map
where no other key of the bucket falls on its bit); the number of set bits before a key's bit is its slot, so n keys have
the slots 0 to n-1. A slot stores a 64-bit fingerprint of the key, the place of its first document in key order, and how
many documents share the key. A lookup reads one slot; a key that was never stored fails the fingerprint.

Null texts are empty: their only id is the end id. A null key is a key like others and sorts first. Documents of one key
are stored side by side, in the order of their texts' hashes. An empty table has no shards and no buckets.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger.llm.shared import file_system, new_folder
from landledger.llm.textscan import mix
from landledger.llm.tokens import encoded

MAGIC = b"TOKIDS01"
KEYS_PER_BUCKET = 4096
#: A key with more documents than this is looked up as several ranges.
RANGE = 1 << 14
SHARDS = "part int, name string, docs long, ids long"
INDEX = "bucket long, bits binary, sizes array<long>, prints array<long>, first array<long>, many array<long>"


@dataclass
class Store:
    spark: SparkSession
    folder: str

    @property
    def shards(self) -> DataFrame:
        """One row per shard: its place in order, file name, documents and ids."""
        return self.spark.read.schema(SHARDS).parquet(f"{self.folder}/shards")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.folder}/index")

    def layout(self) -> list[tuple[int, str, int, int, int, int]]:
        """(part, name, documents, ids, documents before, ids before) of each shard; a few numbers a file."""
        out, docs, ids = [], 0, 0
        for r in self.shards.orderBy("part").collect():
            out.append((r.part, r.name, r.docs, r.ids, docs, ids))
            docs, ids = docs + r.docs, ids + r.ids
        return out


def _hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(key).isNull())


def write_store(docs: DataFrame, path: str, end: int = 0, text: str = "text", key: str = "doc_id") -> Store:
    spark = docs.sparkSession
    folder = new_folder(spark, "store")
    n_rows = docs.count()
    schema = docs.select(F.col(key).alias("key")).schema
    rows_type = ", ".join(["key " + schema[0].dataType.simpleString(), "part int", "name string", "nth long", "n_ids long"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids"  # a retried task writes another file
        out, lengths = None, []
        for batch, ids, at in encoded(batches, "text", path, end):
            if out is None:
                system, place = file_system(f"{folder}/ids")
                system.create_dir(place)
                out = system.open_output_stream(f"{place}/{name}")
                out.write(MAGIC + np.array([ids.dtype.itemsize, 0], "<u4").tobytes())
            out.write(ids.tobytes())
            sizes = np.diff(at)
            first = sum(map(len, lengths))
            lengths.append(sizes)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.full(n, part), pa.int32()), pa.array([name] * n), pa.array(np.arange(first, first + n)), pa.array(sizes)],
                names=["key", "part", "name", "nth", "n_ids"],
            )
        if out is not None:
            all_sizes = np.concatenate(lengths).astype("<u8")
            out.write(all_sizes.tobytes() + np.array([len(all_sizes)], "<u8").tobytes())
            out.close()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text").mapInArrow(save, rows_type).write.parquet(f"{folder}/rows")
    written = spark.read.parquet(f"{folder}/rows")
    written.groupBy("part", "name").agg(F.count("*").alias("docs"), F.sum("n_ids").alias("ids")).write.parquet(f"{folder}/shards")
    store = Store(spark, folder)
    before = spark.createDataFrame([(part, docs) for part, _, _, _, docs, _ in store.layout()], "part int, before long")
    buckets = max(1, -(-n_rows // KEYS_PER_BUCKET))
    entries = (
        written.join(before, "part").withColumn("at", F.col("nth") + F.col("before"))
        .groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("many"))
        .select(F.pmod(_hash("key", 1), F.lit(buckets)).alias("bucket"), _hash("key", 2).alias("hash"), _hash("key", 3).alias("print"), "first", "many")
    )
    entries.groupBy("bucket").applyInArrow(_build, INDEX).write.parquet(f"{folder}/index")
    return store


def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


def minimal_perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit maps by level, and the slot of each key. Keys are distinct 64-bit values."""
    levels: list[np.ndarray] = []
    left = keys
    while len(left):
        if len(levels) > 200:
            raise ValueError("keys are not distinct")
        size = len(left) * 3 // 2 + 8
        at = _bit(left, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels, slots(levels, keys)


def slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for keys that fall through all levels."""
    out = np.full(len(keys), -1, np.int64)
    before = 0
    for level, bits in enumerate(levels):
        open_ = np.flatnonzero(out < 0)
        at = _bit(keys[open_], level, len(bits))
        ranks = np.cumsum(bits) - 1 + before
        found = bits[at]
        out[open_[found]] = ranks[at[found]]
        before += int(bits.sum())
    return out


def _build(group: pa.Table) -> pa.Table:
    keys = group["hash"].to_numpy().view(np.uint64)
    levels, slot = minimal_perfect_hash(keys)
    order = np.argsort(slot)
    lists = [pa.array([group[name].to_numpy()[order]], pa.list_(pa.int64())) for name in ("print", "first", "many")]
    bits = np.packbits(np.concatenate(levels)).tobytes()
    return pa.Table.from_arrays(
        [pa.array([group["bucket"][0].as_py()], pa.int64()), pa.array([bits], pa.binary()),
         pa.array([[len(x) for x in levels]], pa.list_(pa.int64())), *lists],
        names=["bucket", "bits", "sizes", "prints", "first", "many"],
    )


def lookup(store: Store, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each distinct key: `first`, its first document's place in key order, and `many`, its documents; absent keys have none."""
    n_buckets = store.index.agg(F.max("bucket")).first()[0]
    total = sum(x[2] for x in store.layout())
    buckets = max(1, -(-total // KEYS_PER_BUCKET)) if n_buckets is not None else 1
    kind = keys.schema[key].dataType.simpleString()
    asked = keys.select(F.col(key).alias("key")).distinct().select(
        "key", F.pmod(_hash("key", 1), F.lit(buckets)).alias("bucket"), _hash("key", 2).alias("hash"), _hash("key", 3).alias("print"))

    def find(asked: pa.Table, index: pa.Table) -> pa.Table:
        made = asked.select(["key"])
        n = asked.num_rows
        first, many = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if n and index.num_rows:
            sizes = index["sizes"][0].as_py()
            bits = np.unpackbits(np.frombuffer(index["bits"][0].as_py(), np.uint8)).astype(bool)
            levels = np.split(bits[: sum(sizes)], np.cumsum(sizes)[:-1])
            prints, firsts, manys = (np.array(index[x][0].values) for x in ("prints", "first", "many"))
            slot = slots(levels, asked["hash"].to_numpy().view(np.uint64))
            there = (slot >= 0) & (prints[slot] == asked["print"].to_numpy())
            first[there], many[there] = firsts[slot[there]], manys[slot[there]]
        keep = pa.array(many > 0)
        return made.append_column("first", pa.array(first)).append_column("many", pa.array(many)).filter(keep)

    return asked.groupBy("bucket").cogroup(store.index.groupBy("bucket")).applyInArrow(find, f"key {kind}, first long, many long")


def read_store(store: Store, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per stored document of the keys: key, start (ids of all documents before it), n_tokens and crc32 of its ids."""
    kind = keys.schema[key].dataType.simpleString()
    layout = store.layout()
    folder = store.folder
    starts = np.array([x[4] for x in layout] + [sum(x[2] for x in layout)], np.int64)
    found = lookup(store, keys, key)
    # a range is cut at RANGE documents and dealt to the shards it touches
    ranges = found.select("key", "many", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("many") - 1, F.lit(RANGE))).alias("at"), (F.col("first") + F.col("many")).alias("stop"))
    ranges = ranges.select("key", "at", F.least(F.col("stop"), F.col("at") + RANGE).alias("stop"))

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, stop = batch.column("at").to_numpy(), batch.column("stop").to_numpy()
            lo = np.searchsorted(starts, at, "right") - 1
            hi = np.searchsorted(starts, stop - 1, "right") - 1
            many = hi - lo + 1
            row = np.repeat(np.arange(len(at)), many)
            shard = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            begin = np.maximum(at[row], starts[shard]) - starts[shard]
            end = np.minimum(stop[row], starts[shard + 1]) - starts[shard]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(shard), pa.array(begin), pa.array(end)], names=["key", "shard", "begin", "stop"])

    def read(group: pa.Table) -> pa.Table:
        shard = int(group["shard"][0].as_py())
        _, name, n_docs, n_ids, _, ids_before = layout[shard]
        system, place = file_system(f"{folder}/ids/{name}")
        with system.open_input_file(place) as file:
            head = file.read_at(16, 0)
            width = int(np.frombuffer(head, "<u4", 1, 8)[0])
            if head[:8] != MAGIC:
                raise ValueError(f"{name} is not a shard of ids")
            sizes = np.frombuffer(file.read_at(8 * n_docs, 16 + n_ids * width), "<u8").astype(np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            begin, stop = group["begin"].to_numpy(), group["stop"].to_numpy()
            many = stop - begin
            row = np.repeat(np.arange(len(begin)), many)
            nth = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            order = np.argsort(nth, kind="stable")
            row, nth = row[order], nth[order]
            crc = np.zeros(len(nth), np.int64)
            for a in range(0, len(nth), 512):  # neighbouring documents are read together
                part = nth[a : a + 512]
                first = int(at[part[0]])
                ids = np.frombuffer(file.read_at(int(at[part[-1] + 1] - first) * width, 16 + first * width), f"<u{width}").astype("<u4")
                crc[a : a + 512] = [zlib.crc32(ids[at[k] - first : at[k + 1] - first].data) for k in part]
        return pa.Table.from_arrays(
            [group["key"].take(pa.array(row)), pa.array(ids_before + at[nth]), pa.array(sizes[nth]), pa.array(crc)],
            names=["key", "start", "n_tokens", "ids_crc32"])

    dealt = ranges.mapInArrow(to_shards, f"key {kind}, shard long, begin long, stop long")
    return dealt.groupBy("shard").applyInArrow(read, f"key {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)
