"""Merkle manifest of a table: leaf digests, a tree per group, a tree over the groups, and a proof for every row.

Time-forward processing: a node's digest is a message to its parent. Inside a chunk of `FAN ** HEIGHT` neighbouring leaves
the messages wait in a priority queue ordered by node label (level, place), so a parent finds all its children's digests
together when its turn comes; between chunks the shuffle is the queue. Each round makes one node out of a chunk, so a group
of n rows takes log(n) / log(FAN ** HEIGHT) rounds, and no task ever holds more than one chunk. The reversed sweep starts
at the root: each node receives the siblings on its way to the root (a proof suffix) and hands them on to its children, at
last to the leaves, which prove themselves.

A leaf is the digest of the given fields, each `-` if null, else its UTF-8 byte count, `:` and the value; so every null,
empty or long value has a defined digest. Leaves ascend by key (nulls first); equal keys by their leaf's first 16 digits,
then by place in the table. Groups ascend with null first. A chunk's last run may be short; a lone node is hashed alone as long as its tree has
other nodes. An empty table gives an empty table. Columns not named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landledger.llm.ordered import group_key, numbered
from landledger.llm.shared import staged

FAN = 3
HEIGHT = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_NODE = "tree string, place long, digest string"
_MESSAGE = "tree string, place long, suffix string, subroot string, root string"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """Digest of a row's fields."""
    texts = [v.cast("string") for v in values]
    coded = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def climb(digests: list[str], padded: bool) -> tuple[tuple[int, int, str], dict[tuple[int, int], list[str]]]:
    """The chunk's root (level, place, digest), and each inner node's children. padded: up to HEIGHT even when alone."""
    queue = [(0, at, d) for at, d in enumerate(digests)]  # sorted, hence a heap
    children: dict[tuple[int, int], list[str]] = {}
    while True:
        level, at, first = heapq.heappop(queue)
        if not queue and (level == HEIGHT or not padded):
            return (level, at, first), children
        run = [first]
        while queue and queue[0][0] == level and queue[0][1] // FAN == at // FAN:
            run.append(heapq.heappop(queue)[2])
        children[level + 1, at // FAN] = run
        heapq.heappush(queue, (level + 1, at // FAN, digest(run)))


def descend(root: tuple[int, int, str], children: dict[tuple[int, int], list[str]], suffix: str) -> list[str]:
    """Proof suffixes of the chunk's leaves. One step of a suffix is the run's other nodes, with | for the node itself."""
    queue = [(-root[0], root[1], suffix)]
    leaves = []
    while queue:
        level, at, suffix = heapq.heappop(queue)
        if level == 0:
            leaves.append(suffix)
            continue
        run = children[-level, at]
        for k in range(len(run)):
            heapq.heappush(queue, (level + 1, at * FAN + k, f"{''.join(run[:k])}|{''.join(run[k + 1:])}/{suffix}"))
    return leaves


def fold(own: str, suffix: str) -> str:
    """The root that a leaf and the siblings on its way give."""
    for step in suffix.split("/")[:-1]:
        left, right = step.split("|")
        own = digest([left, own, right])
    return own


def _chunk() -> Column:
    return F.floor(F.col("place") / FAN**HEIGHT).alias("chunk")


def _up(nodes: DataFrame) -> list[DataFrame]:
    """The nodes at the start, after one round, and so on until every tree is one node."""

    def raise_chunk(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        (_, _, top), _ = climb(table["digest"].to_pylist(), key[1].as_py() > 0)
        return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "digest": [top]}, schema=pa.schema([("tree", pa.string()), ("place", pa.int64()), ("digest", pa.string())]))

    rounds = [nodes]
    last = nodes.agg(F.max("place")).first()[0]
    while True:
        chunks = rounds[-1].select("tree", _chunk(), "place", "digest").groupBy("tree", "chunk")
        rounds.append(staged(chunks.applyInArrow(raise_chunk, _NODE), "manifest-up")[0])
        last //= FAN**HEIGHT
        if not last:
            return rounds


def _down(rounds: list[DataFrame], messages: DataFrame, payload: list[str], out, schema: T.StructType | str) -> DataFrame:
    """Messages of the roots handed down; `out` makes the last ones from the leaves' columns, suffixes and the message."""

    def hand(last: bool):
        def deliver(key: tuple, table: pa.Table, sent: pa.Table) -> pa.Table:
            table = table.sort_by("place")
            root, children = climb(table["digest"].to_pylist(), key[1].as_py() > 0)
            message = sent.to_pylist()[0]
            suffixes = descend(root, children, message["suffix"])
            if last:
                return out(table, suffixes, message)
            many = table.num_rows
            return pa.table({"tree": table["tree"], "place": table["place"], "suffix": pa.array(suffixes, pa.string()),
                             "subroot": pa.array([message["subroot"]] * many, pa.string()), "root": pa.array([message["root"]] * many, pa.string())})

        return deliver

    for nodes in reversed(rounds[:-1]):
        last = nodes is rounds[0]
        columns = ["tree", _chunk(), "place", "digest", *(payload if last else [])]
        sent = messages.withColumnRenamed("place", "chunk")
        made = nodes.select(*columns).groupBy("tree", "chunk").cogroup(sent.groupBy("tree", "chunk")).applyInArrow(hand(last), schema if last else _MESSAGE)
        messages = made if last else staged(made, "manifest-down")[0]
    return messages


def _suffixes(table: pa.Table, suffixes: list[str], message: dict) -> pa.Table:
    return pa.table({"tree": table["of"], "place": pa.array([0] * table.num_rows, pa.int64()), "suffix": pa.array(suffixes, pa.string()),
                     "subroot": table["digest"], "root": pa.array([message["root"]] * table.num_rows, pa.string())})


def _proofs(table: pa.Table, suffixes: list[str], message: dict) -> pa.Table:
    folded = [fold(claim, s) for claim, s in zip(table["claim"].to_pylist(), suffixes, strict=True)]
    many = table.num_rows
    return pa.table({
        "key": table["key"], "leaf": table["digest"], "subroot": pa.array([message["subroot"]] * many, pa.string()), "root": pa.array([message["root"]] * many, pa.string()),
        "proof_sha256": pa.array([digest([s.replace("|", "").replace("/", "")]) for s in suffixes], pa.string()),
        "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == message["root"] for f in folded], pa.bool_()),
        "suffix": pa.array(suffixes, pa.string()),
    })


def prove(docs: DataFrame, fields: list[str] = FIELDS, key: str = "doc_id", group: str = "source", claims: dict[str, Column] | None = None) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root, verified, and the proof itself.

    `claims` gives other values of fields, which each row is verified with: its claimed leaf is folded with the siblings
    of the real one. proof: one step a level from the leaf to the root, the run's other digests with | for the own one.
    """
    claimed = [(claims or {}).get(f, docs[f]) for f in fields]
    read = docs.select(docs[key].alias("key"), group_key(docs[group]).alias("tree"), leaf([docs[f] for f in fields]).alias("digest"), leaf(claimed).alias("claim"), F.monotonically_increasing_id().alias("row"))
    leaves, _ = staged(read, "manifest-leaves")
    placed = numbered(leaves, "tree", [F.col("key").asc_nulls_first(), F.unhex(F.substring("digest", 1, 16)), F.col("row")], "manifest-order")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType()), T.StructField("proof", T.StringType())])
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    inner = _up(placed)
    subroots = inner[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    outer = _up(numbered(subroots, "tree", [F.col("of")], "manifest-groups"))
    top = outer[-1].select("tree", "place", F.lit("").alias("suffix"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    roots, _ = staged(_down(outer, top, ["of"], _suffixes, _MESSAGE), "manifest-roots")
    return _down(inner, roots, ["key", "claim"], _proofs, T.StructType([T.StructField("key", schema[0].dataType), *schema.fields[1:-1], T.StructField("suffix", T.StringType())])).toDF(*schema.names)
