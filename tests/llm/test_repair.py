"""Repairs against a search over all edits of each row; long conversations in pieces; ties and awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from landledger.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
LEGAL = re.compile("(s?(ua)+)?")
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def sort_key(row):
    return row[1] is not None, row[1] or 0, row[2].encode(), hashlib.sha256(f"{len(row[2])}:{row[2]}{row[3]}".encode()).digest()


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.findall("[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def edits(row, fault, state):
    """(cost, initial, state, line) of what can become of a row."""
    yield 4, "D", state, []
    if fault not in ("blank", "duplicate"):
        extra = 3 if fault == "truncated" else 0
        for cost, initial, role in ((0, "K", row[2]), (3, "R", "user"), (3, "R", "assistant")):
            if (state, role[:1]) in STEP:
                yield cost + extra, initial, STEP[state, role[:1]], [f"{role}:{row[3]}"]


def cheapest(rows):
    """All answers (cost, audit, lines) for each state, from the last row to the first, with up to three rows put in at a place."""
    found = faults(rows)
    best = {s: (0, "", []) for s in (0, 3)}
    for k in range(len(rows), -1, -1):
        if k < len(rows):
            best = {s: min(((c + best[to][0], i + best[to][1], line + best[to][2]) for c, i, to, line in edits(rows[k], found[k], s) if to in best), default=None) for s in range(4)}
            best = {s: b for s, b in best.items() if b}
        here = dict(best)
        for state, many in itertools.product(range(4), range(1, 4)):
            at, put = state, []
            for _ in range(many):
                role = "assistant" if at == 2 else "user"
                at, put = STEP[at, role[0]], [*put, f"{role}:"]
            if at in best:
                option = (3 * many + best[at][0], "I" * many + best[at][1], put + best[at][2])
                here[state] = min(here.get(state, option), option)
        best = here
    return best[0]


def plain(rows, everyone):
    by = {r[0]: [] for r in everyone}
    for r in rows:
        by[r[0]].append(r)
    out = collections.Counter()
    lines_of = {}
    for conv, mine in by.items():
        mine.sort(key=sort_key)
        found, turns = faults(mine), [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = cheapest(mine)
        assert LEGAL.fullmatch("".join(x[0] for x in lines))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv, gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
        lines_of[conv] = lines
    return out, lines_of


def awkward(seed=5, convs=70):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Stop!", " ", "x. \n", None, "", "why?", "cut off", "日本。", "long " * 3_000]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]
    return [(c, rng.choice([None, k, k, k, rng.randint(0, 9)]), rng.choice(roles), rng.choice(texts)) for c in [*range(convs), None] for k in range(rng.choice([1, 2, 5, 9, 45]))]


@pytest.mark.parametrize(("piece", "fan"), [(repair.PIECE, repair.FAN), (4, 3), (1, 2)])
def test_report_equals_the_search(spark, monkeypatch, piece, fan):
    monkeypatch.setattr(repair, "PIECE", piece)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in ("conv", "row", "place", "signature", "rows")})
    got = repair.report(repair.damage(df), everyone=df)
    assert collections.Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == plain(list(damaged(rows)), rows)[0]


def test_repaired_rows(spark):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in awkward(seed=6, convs=20)]
    got = collections.defaultdict(list)
    for r in sorted(repair.repaired(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), key=lambda r: r.turn):
        got[r.conv_id].append(f"{r.role}:{r.text}")
    assert got == {conv: lines for conv, lines in plain(rows, rows)[1].items() if lines}


def test_ties_take_the_least_audit(spark):
    # a user row too many: Delete costs 4, an answer put in costs 3; a lone assistant row: I 3 before it, Delete 4
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "assistant", "d."), (3, 0, "user", "cut"), (4, 0, "system", "s.")]
    got = {r.conv_id: (r.cost, r.audit) for r in repair.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (3, "KIKK"), 2: (3, "IK"), 3: (4, "D"), 4: (4, "D")}


def test_nothing_left_and_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(none).collect() == [] and repair.repaired(none).collect() == []
    (r,) = repair.report(none, everyone=spark.createDataFrame([(5, 0, "user", "x.")], SCHEMA)).collect()
    assert tuple(r[c] for c in COLUMNS) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_vectors_are_closed():
    for costs in repair.BY_NUMBER:
        for letter in repair.LETTERS:
            assert repair._normal(tuple(m[0] for m in repair.moves(letter, costs))) in repair.VECTORS
