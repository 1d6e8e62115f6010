"""Cheapest repair of conversations, worked out once for every shared ending.

Rows become letters: the role's initial (capital where the text breaks off, `x` for any other role) or `d` for a row that
has to go. A conversation's letters are its signature. Read from the end, signatures share their suffixes: sorted by the
reversed signature, each suffix is one node of the automaton, made once from the node behind it, with the cost to go, the
best audit suffix and the state left in, for each of the four grammar states. In one state no two of the moves Delete,
Insert, Keep and Rerole share an initial, so among equal costs the ASCII-least initial settles the least audit.

Long conversations are cut into pieces of `PIECE` rows. Costs to go, less their least, take only a few values (VECTORS,
closed under all letters), so a piece is a function from the vector behind it to the one before it; these functions are
composed over a conversation's pieces in rounds of up to `FAN`, from the end for the vectors and from the start for the
states. No task holds more than a piece's rows or FAN functions; a digest of the repaired texts is one chain, which a
task reads as a sorted stream without holding it.

Null roles and texts are one space; conversations without an id are one conversation. Rows ascend by turn (nulls first),
rows of the same turn by role, then by digest. An empty role has no initial and can't be kept. Repeated rows are
duplicates. An empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.llm.ordered import group_key, numbered
from landledger.llm.shared import staged

BLANKS = " \t\n\x0b\x0c\r"
PIECE = 1024
FAN = 1024
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; the role that can come next, and the state after it.
NEXT = ("u", "u", "a", "u")
AFTER = (2, 2, 3, 2)
LETTERS = "suaxSUAXd"
NAMES = {"u": "user", "a": "assistant"}
END = (0, 2 * INSERT, INSERT, 0)

Moves = list[tuple[int, str, int]]


def moves(letter: str, costs: tuple[int, ...]) -> Moves:
    """Cost to go, first initial and next state for each grammar state in front of a row."""
    ahead: list[list[tuple[int, str, int]]] = []
    extra = TRUNCATED if letter.isupper() else 0
    initial = letter.lower()
    for state in range(4):
        options = [(DELETE + costs[state], "D", state)]
        if letter != "d":
            to = AFTER[state]
            options.append((REROLE + extra + costs[to], "R", to))
            if initial == NEXT[state]:
                options.append((extra + costs[to], "K", to))
            if initial == "s" and state == 0:
                options.append((extra + costs[1], "K", 1))
        ahead.append(options)
    best = [min(o) for o in ahead]
    for state in (2, 3, 0, 1):  # what is put in before the row: at most one user or assistant, the other would come of no use
        other = best[AFTER[state]]
        if other[1] != "I" or state < 2:
            best[state] = min(best[state], (INSERT + other[0], "I", AFTER[state]))
    return best


def _normal(costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(c - min(costs) for c in costs)


def _vectors() -> dict[tuple[int, ...], int]:
    """All costs to go less their least, numbered; they are closed under every letter."""
    found, open_ = {END: 0}, [END]
    while open_:
        costs = open_.pop()
        for letter in LETTERS:
            ahead = _normal(tuple(m[0] for m in moves(letter, costs)))
            if ahead not in found:
                found[ahead] = len(found)
                open_.append(ahead)
    return found


VECTORS = _vectors()
BY_NUMBER = list(VECTORS)
STEPS = {letter: [VECTORS[_normal(tuple(m[0] for m in moves(letter, costs)))] for costs in BY_NUMBER] for letter in LETTERS}
#: What is behind the last piece of a conversation; other pieces have a vector's number.
LAST = -1


class Node:
    """A suffix: cost to go, audit and state at its end, for each state in front of it."""

    __slots__ = ("audits", "costs", "lefts")

    def __init__(self, costs: tuple[int, ...], audits: tuple[str, ...], lefts: tuple[int, ...]):
        self.costs, self.audits, self.lefts = costs, audits, lefts

    @classmethod
    def end(cls, behind: int) -> Node:
        if behind == LAST:
            return cls(END, ("", "II", "I", ""), (0, 3, 3, 3))
        return cls(BY_NUMBER[behind], ("", "", "", ""), (0, 1, 2, 3))

    def before(self, letter: str) -> Node:
        best = moves(letter, self.costs)
        audits, lefts = list(self.audits), list(self.lefts)
        for state in range(4):
            at, made = state, ""
            while best[at][1] == "I":
                made, at = made + "I", best[at][2]
            _, initial, to = best[at]
            audits[state], lefts[state] = made + initial + self.audits[to], self.lefts[to]
        return Node(tuple(b[0] for b in best), tuple(audits), tuple(lefts))


def rows_of(audit: str, letters: str, state: int) -> Iterator[tuple[int, str, str]]:
    """(place, roles put in before it, what becomes of it: K, D or the new role) for each letter, then for the end."""
    at, put = 0, ""
    for initial in audit:
        if initial == "I":
            put += NEXT[state]
            state = AFTER[state]
            continue
        became = NEXT[state] if initial == "R" else initial
        if initial == "K" and letters[at].lower() == "s":
            state = 1
        elif initial != "D":
            state = AFTER[state]
        yield at, put, became
        at, put = at + 1, ""
    yield at, put, "D"


def _faults(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows written with a number, then ordered and told apart: blank, duplicate and truncated as the first fault."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    trimmed = F.rtrim(text, F.lit(BLANKS))
    seen = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows, _ = staged(convs.select(group_key(F.col("conv_id")).alias("conv"), "conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row")), "repair-rows")
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "conv", "row", "turn", "role", seen.alias("seen"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
    )
    placed = numbered(narrow, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("seen"), F.col("row")], "repair-order")
    first = placed.where("NOT blank").groupBy("conv", "seen").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    told = placed.join(first.drop("n"), ["conv", "seen"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    told = told.select("conv", "row", "turn", "place", "initial", "blank", duplicate.alias("duplicate"), (~F.col("blank") & ~duplicate & F.col("cut")).alias("truncated"))
    letter = F.when(F.col("blank") | F.col("duplicate"), "d").when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    return rows, staged(told.withColumn("letter", letter), "repair-faults")[0]


def _pieces(told: DataFrame) -> DataFrame:
    """conv, piece, n_pieces, signature, its rows' numbers, and illegal neighbours; a row that opens a piece is the last one's neighbour."""
    own = F.floor(F.col("place") / PIECE)
    at = F.when((F.col("place") % PIECE == 0) & (F.col("place") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = told.select("conv", F.explode(at).alias("piece"), "place", "row", "letter", "initial")
    listed = dealt.groupBy("conv", "piece").agg(F.array_sort(F.collect_list(F.struct("place", "row", "letter", "initial"))).alias("rows"))
    listed = listed.withColumn("initials", F.array_join(F.transform("rows", lambda r: r["initial"]), ""))
    pairs = F.transform(F.sequence(F.lit(1), F.length("initials")), lambda k: F.substring(F.col("initials"), k, F.lit(2)))
    wrong = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))
    mine = F.filter("rows", lambda r: r["place"] < (F.col("piece") + 1) * PIECE)
    return listed.select(
        "conv", "piece", F.array_join(F.transform(mine, lambda r: r["letter"]), "").alias("signature"),
        F.transform(mine, lambda r: r["row"]).alias("rows"), wrong.cast("long").alias("illegal"),
    )


def scanned(functions: DataFrame, start: int, backwards: bool) -> DataFrame:
    """conv, piece and `given`: `start` through the functions (array of numbers) of all pieces behind, or before, this one."""
    sign = -1 if backwards else 1

    def along(table: pa.Table, value: int) -> tuple[list[int], list[int]]:
        pieces, given = [], []
        for r in sorted(table.to_pylist(), key=lambda r: sign * r["piece"]):
            pieces.append(r["piece"])
            given.append(value)
            value = r["fn"][value]
        return pieces, given

    def answer(conv: object, found: tuple[list[int], list[int]]) -> pa.Table:
        return pa.table({"conv": pa.array([conv.as_py()] * len(found[0]), pa.string()), "piece": pa.array(found[0], pa.int64()), "given": pa.array(found[1], pa.int32())})

    def composed(key: tuple, table: pa.Table) -> pa.Table:
        steps = [r["fn"] for r in sorted(table.to_pylist(), key=lambda r: sign * r["piece"])]
        whole = list(range(len(steps[0])))
        for fn in steps:
            whole = [fn[v] for v in whole]
        return pa.table({"conv": [key[0].as_py()], "piece": [key[1].as_py()], "fn": pa.array([whole], pa.list_(pa.int32()))})

    def one(key: tuple, table: pa.Table) -> pa.Table:
        return answer(key[0], along(table, start))

    def part(key: tuple, table: pa.Table, sent: pa.Table) -> pa.Table:
        return answer(key[0], along(table, sent["given"][0].as_py()))

    result, last = "conv string, piece long, given int", functions.agg(F.max("piece")).first()[0]
    if last is None or last < FAN:
        return functions.groupBy("conv").applyInArrow(one, result)
    blocks = functions.withColumn("block", F.floor(F.col("piece") / FAN))
    whole, _ = staged(blocks.groupBy("conv", "block").applyInArrow(composed, "conv string, piece long, fn array<int>"), "repair-scan")
    given = scanned(whole, start, backwards).withColumnRenamed("piece", "block")
    return blocks.groupBy("conv", "block").cogroup(given.groupBy("conv", "block")).applyInArrow(part, result)


def _walked(pieces: DataFrame, extra: list[str]) -> DataFrame:
    """conv, piece and, for every state in front of the piece, its audit, cost and the state it leaves in.

    Sorted by what is behind and the reversed signature, so that a shared suffix is computed once for all that have it.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, nodes, behind = "", [], None
        for batch in batches:
            out = {"audits": [], "costs": [], "lefts": []}
            for end, turned in zip(batch.column("behind").to_pylist(), batch.column("turned").to_pylist(), strict=True):
                if end != behind:
                    path, nodes, behind = "", [Node.end(end)], end
                shared = len(commonprefix([path, turned]))
                del nodes[shared + 1 :]
                for letter in turned[shared:]:
                    nodes.append(nodes[-1].before(letter))
                path, node = turned, nodes[-1]
                back = nodes[0].costs if end != LAST else (0, 0, 0, 0)
                out["audits"].append(node.audits)
                out["costs"].append([c - back[left] for c, left in zip(node.costs, node.lefts, strict=True)])
                out["lefts"].append(node.lefts)
            kept = [batch.column(c) for c in ("conv", "piece", *extra)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out["audits"], pa.list_(pa.string())), pa.array(out["costs"], pa.list_(pa.int64())), pa.array(out["lefts"], pa.list_(pa.int32()))], ["conv", "piece", *extra, *out])

    turned = pieces.select("conv", "piece", "behind", F.reverse("signature").alias("turned"), *extra)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select("conv", "piece", *extra).schema)
    ordered = turned.repartitionByRange("behind", "turned", "conv", "piece").sortWithinPartitions("behind", "turned")
    return ordered.mapInArrow(walk, f"{kinds}, audits array<string>, costs array<long>, lefts array<int>")


def _function(signature: str) -> list[int]:
    """The vector in front of a piece for each vector behind it."""
    out = list(range(len(BY_NUMBER)))
    for letter in reversed(signature):
        out = [STEPS[letter][v] for v in out]
    return out


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fns = [_function(s) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("piece"), pa.array(fns, pa.list_(pa.int32()))], ["conv", "piece", "fn"])


def _audited(pieces: DataFrame) -> DataFrame:
    """Each piece with its audit, its cost and the state in front of it."""
    pieces, _ = staged(pieces, "repair-pieces")
    ends = pieces.groupBy("conv").agg(F.max("piece").alias("last"))
    long = ends.where("last > 0")
    pieces = pieces.join(long, "conv", "left")  # a row a conversation at most, and few: most have one piece
    fns = pieces.where("last IS NOT NULL").select("conv", "piece", "signature").mapInArrow(_functions, "conv string, piece long, fn array<int>")
    given = scanned(staged(fns, "repair-functions")[0], 0, backwards=True)
    behind = F.when(F.col("piece") == F.coalesce("last", F.lit(0)), LAST).otherwise(F.col("given"))
    known = pieces.join(given, ["conv", "piece"], "left").withColumn("behind", behind.cast("int")).drop("given")
    walked, _ = staged(_walked(known, ["last", "signature", "rows", "illegal"]), "repair-walked")
    states = scanned(walked.where("last IS NOT NULL").select("conv", "piece", F.col("lefts").alias("fn")), 0, backwards=False)
    state = F.coalesce("given", F.lit(0))
    told = walked.join(states, ["conv", "piece"], "left").withColumn("state", state)
    return told.select("conv", "piece", "signature", "rows", "illegal", "state", F.get("audits", F.col("state")).alias("audit"), F.get("costs", F.col("state")).alias("cost"))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"conv": [], "place": [], "row": [], "put": [], "became": []}
        for r in batch.to_pylist():
            for at, put, became in rows_of(r["audit"], r["signature"], r["state"]):
                if put or became != "D":
                    ends = at == len(r["signature"])
                    out["conv"].append(r["conv"])
                    out["place"].append(2 * (r["piece"] * PIECE + at) - (1 if ends else 0))
                    out["row"].append(None if ends else r["rows"][at])
                    out["put"].append(put)
                    out["became"].append(became)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("conv", pa.string()), ("place", pa.int64()), ("row", pa.int64()), ("put", pa.string()), ("became", pa.string())]))


def _lines(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv, place and the repaired rows there (those put in first), as role and text."""
    edits = audited.select("conv", "piece", "signature", "rows", "state", "audit").mapInArrow(_edits, "conv string, place long, row long, put string, became string")
    none = F.array().cast("array<struct<role:string,text:string>>")
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    put = F.when(F.col("put") == "", none).otherwise(F.transform(F.split("put", ""), lambda i: F.struct(names[i].alias("role"), F.lit("").alias("text"))))
    own = F.when(F.col("became") == "D", none).otherwise(F.array(F.struct(F.when(F.col("became") == "K", F.col("role")).otherwise(names[F.col("became")]).alias("role"), "text")))
    return edits.join(rows.select("row", "role", "text"), "row", "left").select("conv", "place", F.concat(put, own).alias("lines"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    last, chain = None, hashlib.sha256()
    for batch in batches:
        done = []
        for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if conv != last:
                if last is not None:
                    done.append({"conv": last, "repaired_sha256": chain.hexdigest()})
                last, chain = conv, hashlib.sha256()
            else:
                chain.update(b"\n")
            chain.update(line.encode())
        yield pa.RecordBatch.from_pylist(done, schema)
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"conv": last, "repaired_sha256": chain.hexdigest()}], schema)


def repaired(convs: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0), role and text."""
    rows, told = _faults(convs)
    audited = _audited(_pieces(told))
    lines = _lines(rows, audited).select("conv", F.explode("lines").alias("line"), F.col("place").alias("after"), F.monotonically_increasing_id().alias("at"))
    placed = numbered(lines, "conv", [F.col("after"), F.col("at")], "repair-lines")
    ids = rows.groupBy("conv").agg(F.max("conv_id").alias("conv_id"))
    return placed.join(ids, "conv").select("conv_id", F.col("place").alias("turn"), "line.role", "line.text")


def report(convs: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """Per conversation of `everyone` (a table with conv_id, by default convs): its faults, the cheapest repair and its digest."""
    rows, told = _faults(convs)
    audited, _ = staged(_audited(_pieces(told)), "repair-audited")
    turns = told.groupBy("conv").agg(
        F.max("turn").alias("most"), F.min("turn").alias("least"), F.count_distinct("turn").alias("turns"),
        *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long")
    audits = audited.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "").alias("audit"),
    )
    line = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    lines = _lines(rows, audited).select("conv", "place", line.alias("line"))
    chains = lines.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_chain, "conv string, repaired_sha256 string")
    ids = (convs if everyone is None else everyone).select("conv_id").distinct().withColumn("conv", group_key(F.col("conv_id")))
    found = ids.join(turns.withColumn("gaps", gaps), "conv", "left").join(audits, "conv", "left").join(chains, "conv", "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def damage(convs: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given to the user, by a checksum of id and turn."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(told[0], F.lit(":"), told[1])) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return convs.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")
