"""Near duplicates: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Each text's shingles are hashed to 64 bits. Texts with the same set (exact copies and the like) are one
   representative with a number of copies; from here on only representatives move.
2. MinHash in fixed bands, in place of an LSH forest: two texts are candidates where they share a prefix of the minima of
   one of `TREES` trees. Its depth is the same for all, the longest that finds a pair at the threshold with the target
   recall, 1 - (1 - threshold^depth)^trees >= `RECALL`; pairs above the threshold are found more surely.
3. The sharers of a prefix are linked to its least member, which keeps the links linear in the sharers; the connected
   groups of these links hold every candidate pair.
4. Exact verification inside each group. A group of more than `TILE` members is cut into bands by set size (sets of
   bands that are not neighbours cannot be similar) and by hash, and each pair of blocks that can hold a similar pair is
   one tile: no pair is dropped, none is met twice, and no task holds more than two blocks. A tile gives each member the
   number of its similar texts (weighted by copies) and a link to a similar one; pairs are never written.
5. The verified links' components are the classes.

Null, empty and word-less texts have no shingles: each is a class of its own without links. A text of one to four words
has one shingle, all its words. Repeated rows are copies of each other. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landledger.llm.components import components
from landledger.llm.shared import fresh, slices, staged, text_bytes
from landledger.llm.textscan import ALNUM, LOWER, mix, shingles, span_hashes, word_spans

WORDS = 5
THRESHOLD = (4, 5)
TREES, DEEPEST, RECALL = 20, 8, 0.9995
#: Members that one task compares with each other, or with as many.
TILE = 512


def prefix_depth(threshold: float = THRESHOLD[0] / THRESHOLD[1], trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix that still finds a pair at the threshold with the target recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and row bounds."""
    raw, offsets = text_bytes(column)
    raw = LOWER[raw]
    starts, ends, bounds = word_spans(raw, offsets, ALNUM)
    hashes, at = shingles(span_hashes(raw, starts, ends), bounds, WORDS)
    rows = np.repeat(np.arange(len(column)), np.diff(at))
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[keep], rows[keep]
    return hashes, np.searchsorted(rows, np.arange(len(column) + 1))


def _per_row(ufunc: np.ufunc, values: np.ndarray, at: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(at) - 1, empty, np.uint64)
    filled = at[1:] > at[:-1]
    if filled.any():
        out[filled] = ufunc.reduceat(values, at[:-1][filled])
    return out


def _marks(hashes: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, and the hashed prefix of its signature in each trie."""
    key1 = _per_row(np.add, mix(hashes), at, 0)
    key2 = _per_row(np.add, mix(hashes ^ np.uint64(0xD1B54A32D192ED03)), at, 0)
    random = np.random.default_rng(20)
    prefixes = np.zeros((len(at) - 1, TREES), np.uint64)
    for tree in range(TREES):
        factors = random.integers(0, 1 << 63, DEEPEST, np.uint64) * np.uint64(2) + np.uint64(1)
        for level in range(depth):
            prefixes[:, tree] = mix(prefixes[:, tree] + _per_row(np.minimum, hashes * factors[level], at, 0))
    return key1, key2, prefixes


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def _signed(docs: DataFrame, text: str, names: list[str], depth: int) -> DataFrame:
    """docs with key1, key2, size and prefixes under the given names."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            hashes, at = shingle_sets(batch.column(text))
            key1, key2, prefixes = _marks(hashes, at, depth)
            made = [pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(np.diff(at), pa.int64()),
                    _lists(prefixes.ravel(), np.arange(batch.num_rows + 1) * TREES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    kinds = (T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()))
    made = [T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)]
    return docs.mapInArrow(sign, T.StructType([*docs.schema.fields, *made]))


def _compare(tile: pa.Table) -> pa.Table:
    """For each member: copies of its similar texts, and the tile's least text that it is connected to."""
    ids, copies, side = (tile[x].to_numpy() for x in ("rep", "copies", "side"))
    order = np.argsort(ids, kind="stable")
    ids, copies, side = ids[order], copies[order], side[order]
    sets = tile["hashes"].take(pa.array(order)).combine_chunks()
    at = np.asarray(sets.offsets, np.int64) - sets.offsets[0].as_py()
    flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
    sizes, n = np.diff(at), len(ids)
    within = bool(tile["within"][0].as_py())
    links, parent = np.zeros(n, np.int64), np.arange(n)

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    mine = np.zeros(int(flat.max()) + 1 if len(flat) else 0, np.int32)
    for a in range(n):
        if not within and side[a]:
            continue
        own = flat[at[a] : at[a + 1]]
        mine[own] = 1
        shared = np.add.reduceat(mine[flat], at[:-1])
        mine[own] = 0
        close = THRESHOLD[1] * shared >= THRESHOLD[0] * (sizes + sizes[a] - shared)
        close &= (np.arange(n) > a) if within else (side == 1)
        others = np.flatnonzero(close)
        if len(others):
            links[a] += copies[others].sum()
            links[others] += copies[a]
            for b in others.tolist():
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    keep = np.flatnonzero(links)
    roots = np.array([ids[find(a)] for a in keep.tolist()], np.int64)
    return pa.table({"rep": pa.array(ids[keep]), "links": pa.array(links[keep]), "root": pa.array(roots)})


def _tiles(members: DataFrame) -> DataFrame:
    """members: comp, rep, size, copies. One row per member and tile it takes part in."""
    total = members.groupBy("comp").agg(F.count("*").alias("comp_size"))
    banded = members.join(total, "comp").withColumn("band", F.when(F.col("comp_size") <= TILE, 0).otherwise(F.floor(F.log(F.col("size")) / math.log(1.25)).cast("long")))
    parts = banded.groupBy("comp", "band").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    here = banded.join(parts, ["comp", "band"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    up = parts.select("comp", (F.col("band") - 1).alias("band"), F.col("parts").alias("parts_up"))
    down = parts.select("comp", (F.col("band") + 1).alias("band"), F.col("parts").alias("parts_down"))
    here = here.join(up, ["comp", "band"], "left").join(down, ["comp", "band"], "left")

    def tile(band, low, high, within, side):
        return F.struct(band.alias("tile_band"), low.alias("low"), high.alias("high"), F.lit(within).alias("within"), side.cast("int").alias("side"))

    number = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    same = F.transform(number, lambda p: F.when(p == F.col("part"), tile(F.col("band"), p, p, True, F.lit(0))).otherwise(
        tile(F.col("band"), F.least(p, F.col("part")), F.greatest(p, F.col("part")), False, F.col("part") > p)))
    # a tile across two bands is named by the lower band; its parts in the upper one count from -1 downwards
    above = F.when(F.col("parts_up").isNull(), F.slice(same, 1, 0)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts_up") - 1), lambda p: tile(F.col("band"), F.col("part"), -1 - p, False, F.lit(0))))
    below = F.when(F.col("parts_down").isNull(), F.slice(same, 1, 0)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts_down") - 1), lambda p: tile(F.col("band") - 1, p, -1 - F.col("part"), False, F.lit(1))))
    spread = F.concat(same, F.when(F.col("comp_size") > TILE, F.concat(above, below)).otherwise(F.slice(same, 1, 0)))
    return here.select("comp", "rep", "size", "copies", F.explode(spread).alias("t")).select("comp", "rep", "size", "copies", "t.*")


def marked(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs, written once, with a number, set digests, set size and prefixes for each row; and these columns' names."""
    plain = ("row", "key1", "key2", "size", "prefixes")
    names: dict[str, str] = {}
    for name in plain:
        names[name] = fresh([*docs.columns, *names.values()], f"near_{name}")
    signed = _signed(docs, text, [names[x] for x in plain[1:]], prefix_depth())
    rows, _ = staged(signed.withColumn(names["row"], F.monotonically_increasing_id()), "marked")
    return rows, names


def classes(rows: DataFrame, names: dict[str, str], text: str = "text") -> DataFrame:
    """row, class_row (the class's least row) and links (similar rows, copies included) of each marked row."""
    c = {k: F.col(v) for k, v in names.items()}
    slim = rows.select(c["row"].alias("row"), c["key1"].alias("key1"), c["key2"].alias("key2"), c["size"].alias("size"), c["prefixes"].alias("prefixes"))
    filled = slim.where("size > 0")
    keys = ["key1", "key2", "size"]
    first_row = filled.groupBy(*keys).agg(F.min(F.struct("row", "prefixes")).alias("first"), F.count("*").alias("copies"))
    reps, _ = staged(first_row.select(*keys, F.col("first.row").alias("rep"), "copies", F.col("first.prefixes").alias("prefixes")), "reps")
    shared = reps.select("rep", F.posexplode("prefixes").alias("tree", "prefix"))
    first = shared.groupBy("tree", "prefix").agg(F.min("rep").alias("v"), F.count("*").alias("n")).where("n > 1")
    candidates = components(shared.join(first, ["tree", "prefix"]).select(F.col("rep").alias("u"), "v"))
    members, _ = staged(candidates.select(F.col("root").alias("comp"), F.col("node").alias("rep")).join(reps.select("rep", "size", "copies"), "rep"), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, at = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), _lists(hashes, at)], names=["rep", "hashes"])

    texts = rows.select(c["row"].alias("rep"), F.col(text).alias("text")).join(members.select("rep"), "rep", "left_semi")
    tiles = _tiles(members).join(texts.mapInArrow(sets, "rep long, hashes array<long>"), "rep")
    compared, _ = staged(tiles.groupBy("comp", "tile_band", "low", "high").applyInArrow(_compare, "rep long, links long, root long"), "compared")
    linked = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(compared.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    told = reps.select(*keys, "rep", "copies").join(linked, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        *keys, F.coalesce("root", "rep").alias("class_row"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return (filled.select("row", *keys).join(told, keys).select("row", "class_row", "links")
            .unionByName(slim.where("size = 0").select("row", F.col("row").alias("class_row"), F.lit(0).cast("long").alias("links"))))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: class_id (the least key in its class), n_links (other documents at the threshold or above) and n_shingles."""
    rows, names = marked(docs.select(key, text), text)
    slim = rows.select(F.col(names["row"]).alias("row"), F.col(key).alias("key"), F.col(names["size"]).alias("n_shingles"))
    told = slim.join(classes(rows, names, text), "row")
    told, _ = staged(told, "classes")
    least = told.groupBy("class_row").agg(F.min("key").alias("class_id"))
    return told.join(least, "class_row").select(F.col("key").alias(key), "class_id", F.col("links").alias("n_links"), "n_shingles")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each class: the one of the least key, or of its first row among equal keys. Same columns."""
    rows, names = marked(docs, text)
    told = rows.select(F.col(names["row"]).alias("row"), F.col(key).alias("key")).join(classes(rows, names, text), "row")
    kept = told.groupBy("class_row").agg(F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("best")).select(F.col("best.row").alias(names["row"]))
    return rows.join(kept, names["row"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
