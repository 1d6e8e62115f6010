import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from landledger.functions import cells as K
from landledger.operators import agreement as A
from landledger.operators import corpus as T
from landledger.operators import grading as Q
from landledger.operators import stages as S
from landledger.operators import usage as U
from landledger.policy import price_table
from landledger.sources.runs import RECORD_SCHEMA

# answer, golden, strict, geometry, near miss
CELLS = [
    ("5", "5", True, True, True), ("6", "5", False, True, True), ("8", "5", False, False, True),
    ("30", "5", False, False, False), ("1030", "1000", False, False, True), ("1005", "1000", False, True, True),
    ("3.4921141716569464", "3.5", True, True, True), ("3.44", "3.5", False, False, False),
    ("100.05", "100.0", True, True, True), ("100.5", "100.0", False, True, True), ("102.0", "100.0", False, False, False),
    ("Cattle", "cattle", True, True, True), ("soya ", "soya", True, True, True), ("x", "y", False, False, False),
    ("yes", "True", True, True, True), ("1", "true", True, True, True), ("0", "TRUE", False, False, False),
    ("1", "1", True, True, True), ("2", "true", False, False, False), ("maybe", "true", False, False, False),
    ("", "", True, True, True), ("", "0", False, False, False), ("5.0", "5", True, True, True),
    ("nan", "nan", False, False, False), ("inf", "inf", True, True, True), ("1_000", "1000", True, True, True),
    ("1e3", "1000", True, True, True), ("5f", "5", False, False, False), ("0.0000001", "0.0", True, True, True),
    (" 7 ", "7", True, True, True), ("+7", "7", True, True, True), (".5", "0.5", True, True, True),
]


def test_cell_comparison_in_both_forms(spark):
    """The column expression and the table kernel judge every cell alike."""
    from landledger.functions.pairing import match_grid

    rows = [(i, *c) for i, c in enumerate(CELLS)]
    df = spark.createDataFrame(rows, "i int, a string, g string, strict boolean, geo boolean, near boolean")
    df = df.select("*", K.parse(F.col("a")).alias("pa"), K.parse(F.col("g")).alias("pg"))
    p = F.col("pa"), F.col("pg")
    got = df.select(
        "i", "pa", "pg", "strict", "geo", "near",
        K.matches(*p, F.lit(False)).alias("s"), K.matches(*p, F.lit(True)).alias("x"),
        K.matches(*p, F.lit(False), K.NEAR_MISS_FACTOR).alias("n"),
    ).collect()
    for r in got:
        assert (r.s, r.x, r.n) == (r.strict, r.geo, r.near), CELLS[r.i]
        a, g = [[r.pa.asDict()]], [[r.pg.asDict()]]
        kernel = [bool(match_grid(a, g, geo, slack)[0][0][0, 0]) for geo, slack in ((False, 1.0), (True, 1.0), (False, 10.0))]
        assert kernel == [r.strict, r.geo, r.near], CELLS[r.i]


GOLDEN = {
    "q1": [["a", "1", "2.5"], ["b", "2", "3.5"], ["c", "3", "4.5"]],
    "q2": [["x", "1"], ["x", "1"], ["y", "1"]],
}


def graded(spark, answers, geometry=False):
    """answers: {(run, qid): rows or None}; None is a missing file."""
    golden = spark.createDataFrame(
        [(q, i, r) for q, rows in GOLDEN.items() for i, r in enumerate(rows)], "qid string, row_no int, cells array<string>"
    )
    given = spark.createDataFrame(
        [(run, q, i, r) for (run, q), rows in answers.items() if rows for i, r in enumerate(rows)],
        "run string, qid string, row_no int, cells array<string>",
    )
    expected = spark.createDataFrame(
        [(run, q, rows is not None) for (run, q), rows in answers.items()], "run string, qid string, written boolean"
    )
    questions = spark.createDataFrame(
        [(q, geometry, ["name", "n", "ha"][: len(rows[0])]) for q, rows in GOLDEN.items()],
        "qid string, geometry boolean, header array<string>",
    )
    return Q.grade(expected, given, golden, questions)


def test_outcomes_and_diffs(spark):
    g = GOLDEN["q1"]
    answers = {
        ("exact", "q1"): g,
        ("shuffled", "q1"): [[r[2], r[0].upper(), r[1]] for r in reversed(g)],
        ("precise", "q1"): [[a, b, f"{float(c) + 0.0004}"] for a, b, c in g],
        ("near", "q1"): [[a, b, f"{float(c) * 1.008}" if a == "c" else c] for a, b, c in [["a", "1", "2.5"], ["b", "2", "3.5"], ["c", "3", "450.5"]]],
        ("far", "q1"): [["a", "1", "2.5"], ["b", "2", "9.5"], ["c", "3", "4.5"]],
        ("short", "q1"): g[:2], ("wide", "q1"): [r + ["z"] for r in g], ("ragged", "q1"): [g[0], g[1][:2], g[2]],
        ("empty", "q1"): [], ("none", "q1"): None, ("copies", "q2"): [["y", "1"], ["x", "1"], ["x", "1"]],
        ("copies_off", "q2"): [["y", "1"], ["y", "1"], ["x", "1"]],
    }
    GOLDEN["q1"] = g
    out = graded(spark, answers)
    got = {r.run: r.outcome for r in out.collect()}
    assert got == {
        "exact": "correct", "shuffled": "correct", "precise": "correct", "near": "wrong", "far": "wrong",
        "short": "wrong", "wide": "wrong", "ragged": "unparseable", "empty": "unparseable", "none": "missing",
        "copies": "correct", "copies_off": "wrong",
    }
    diffs = {}
    for r in Q.diff_rows(out).collect():
        diffs.setdefault(r.run, []).append(r)
    far = diffs["far"]
    assert [(r.row, r.column, r.golden, r.answer, r.rel_error, r.near_miss) for r in far] == [
        (1, "ha", "3.5", "9.5", round(6 / 3.5, 6), False)
    ]
    assert [(r.kind, r.golden_rows, r.answer_rows, r.golden_columns) for r in diffs["short"]] == [("shape", 3, 2, 3)]
    summary = {r.run: r.summary for r in Q.diff_summary(Q.diff_rows(out)).collect()}
    assert summary["far"] == "1 cells in ha, worst 171.4%"
    assert summary["wide"] == "shape: golden 3x3, answer 3x4"
    counts = {r.run: r for r in Q.outcome_counts(out).collect()}
    assert counts["none"].missing == 1 and counts["exact"].correct == 1


def test_near_miss_and_geometry_slack(spark):
    near = {("r", "q1"): [["a", "1", "2.5"], ["b", "2", "3.5"], ["c", "4", "4.5"]]}
    assert graded(spark, near).first().outcome == "near_miss"
    assert graded(spark, near, geometry=True).first().outcome == "correct"


def test_transitive_dependencies_and_stages(spark):
    qs = spark.createDataFrame(
        [("a", 1, []), ("b", 2, ["a"]), ("c", 3, ["b"]), ("d", 4, ["c"]), ("e", 4, [])],
        "qid string, stage int, depends_on array<string>",
    )
    assert {tuple(r) for r in S.transitive_dependencies(qs).collect()} == {
        ("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("d", "b"), ("d", "a")
    }
    ok, no = "correct", "wrong"
    rows = [("r", "a", no), ("r", "b", ok), ("r", "c", ok), ("r", "d", ok), ("r", "e", no)]
    grades = spark.createDataFrame(rows, "run string, qid string, outcome string")
    got = {r.stage: (r.n, r.raw, r.n_eligible, r.conditional) for r in S.stage_accuracy(grades, qs).collect()}
    assert got == {1: (1, 0.0, 1, 0.0), 2: (1, 1.0, 0, None), 3: (1, 1.0, 0, None), 4: (2, 0.5, 1, 0.0)}


def test_arms_keep_specs_apart(spark):
    cols = "run string, model string, status string, arm string, spec_fingerprint string, " \
           "golden_fingerprint string, graded_against string"
    meta = spark.createDataFrame([
        ("1", "m", None, None, None, None, "g"), ("2", "m", "done", "full", "s1", "g", "g"),
        ("3", "m", "done", "cut", "s2", "g", "g"), ("4", "m", "incomplete", "cut", "s3", "g", "g"),
        ("5", "m", "produced_nothing", "cut", "s2", "g", "g"), ("6", "m", "done", "cut", "s2", "g", "h"),
        ("7", "m", "done", "cut", "s2", "g", "g"),
    ], cols)
    marks = {"1": "cw", "2": "cc", "3": "cw", "4": "ww", "6": "cc"}
    grades = spark.createDataFrame(
        [(r, f"q{i}", "correct" if m == "c" else "wrong") for r, ms in marks.items() for i, m in enumerate(ms)],
        "run string, qid string, outcome string",
    )
    assert {tuple(r) for r in S.exclusions(meta, grades).select("run", "reason").collect()} == {
        ("5", "produced_nothing"), ("6", "regraded"), ("7", "not graded")
    }
    arms = {(r.arm, r.spec): (r.runs, r["mean"]) for r in S.arm_accuracy(meta, grades).collect()}
    assert arms == {("full", None): (1, 0.5), ("full", "s1"): (1, 1.0), ("cut", "s2"): (1, 0.5), ("cut", "s3"): (1, 0.0)}
    moved = {(r.arm, r.spec, r.qid): r.delta for r in S.question_delta(meta, grades).collect()}
    assert moved == {
        ("full", None, "q0"): 0.0, ("full", None, "q1"): -100.0, ("cut", "s2", "q0"): 0.0, ("cut", "s2", "q1"): -100.0,
        ("cut", "s3", "q0"): -100.0, ("cut", "s3", "q1"): -100.0,
    }


# -- agreement ---------------------------------------------------------------------

def plain_tau(x, y):
    c = d = tx = ty = 0
    for i, j in combinations(range(len(x)), 2):
        a, b = x[i] - x[j], y[i] - y[j]
        tx += a == 0
        ty += b == 0
        if a and b:
            c, d = (c + 1, d) if (a > 0) == (b > 0) else (c, d + 1)
    denom = math.sqrt((c + d + tx) * (c + d + ty))
    return (c - d) / denom if denom else None


def test_kendall_tau_against_all_pairs(spark, stages):
    rng = random.Random(11)
    losses = {run: [rng.choice([0, 1, 2, 3.5, 8]) * rng.randrange(5) for _ in range(120)] for run in range(3)}
    rows = [(run, f"P{i}", float(v), "C") for run, vs in losses.items() for i, v in enumerate(vs)]
    art = spark.createDataFrame(rows, "run int, cod_imovel string, loss double, contact string")
    got = {(r.run_a, r.run_b): r.tau for r in A.kendall_tau(art, stages, block=4).collect()}
    assert len(got) == 3
    for (a, b), tau in got.items():
        assert tau == pytest.approx(plain_tau(losses[a], losses[b]))


def artifacts(spark, runs):
    rows = [(i, k, float(v), c) for i, run in enumerate(runs) for k, (v, c) in run.items()]
    return spark.createDataFrame(rows, "run int, cod_imovel string, loss double, contact string")


def test_agreement_of_identical_and_split_runs(spark, stages):
    same = {"A": (3.0, "x"), "B": (2.0, "y"), "C": (1.0, "x")}
    art = artifacts(spark, [same, same, same])
    row = A.consistency(art, art.filter("run = 0"), stages).first()
    assert row[:] == (3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
    assert A.unstable_parcels(art).count() == 0
    other = artifacts(spark, [same, {"A": (3.0, "z"), "D": (1.0, "x")}])
    jac = A.pairwise_jaccard(other).first()
    assert jac.jaccard == pytest.approx(1 / 4)
    assert {r.cod_imovel for r in A.unstable_parcels(other).collect()} == {"B", "C", "D"}
    assert A.contact_agreement(other).first()[0] == pytest.approx(0.5)
    apart = artifacts(spark, [{"A": (1.0, "x")}, {"B": (1.0, "x")}])
    assert A.flag_jaccard(apart).first()[0] == 0.0
    assert A.contact_kappa(artifacts(spark, [same])).first()[0] is None


def test_artifact_cleaning(spark):
    rows = [(1, 1, " A ", "2.5", " x "), (1, 2, "A", "bad", "y"), (1, 3, "  ", "1", "z"), (1, 4, None, "1", "z"), (1, 5, "B", None, None)]
    raw = spark.createDataFrame(rows, "run int, arrival int, cod_imovel string, loss string, contact string")
    assert {tuple(r) for r in A.load_artifacts(raw).collect()} == {(1, "A", 0.0, "y"), (1, "B", 0.0, "")}


# -- transcripts -------------------------------------------------------------------

def records(spark, rows):
    return spark.createDataFrame(rows, "run string, arrival long, type string, tool_use_id string, tool_name string, elapsed_time_seconds double")


def test_heartbeats_count_once_per_call(spark):
    beat = "tool_progress"
    df = records(spark, [("r", 1, beat, "a", "Bash", 30.0), ("r", 2, beat, "a", "Bash", 60.0), ("r", 3, beat, "b", None, 130.0),
                         ("r", 4, beat, "a", "Bash", 90.0), ("r", 5, beat, None, "Bash", 500.0), ("r", 6, "assistant", None, None, None)])
    calls = U.longest_calls(df)
    idle = records(spark, [("idle", 1, "assistant", None, None, None)])
    timed = {r.run: r for r in U.tool_timings(calls, df.unionByName(idle)).collect()}
    assert timed["r"][:] == ("r", 2, 220.0, {"Bash": 90.0, "unknown": 130.0}, 1)
    assert timed["idle"][:] == ("idle", 0, 0.0, {}, 0)
    shown = U.heartbeats(df.filter("type = 'tool_progress' and tool_use_id is not null").withColumn("seconds", F.col("elapsed_time_seconds")))
    assert {(r.tool_use_id, r.shown_at) for r in shown.collect()} == {("a", 60.0), ("b", 130.0)}


def test_usage_is_summed_over_results(spark):
    usage = "struct<input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long>"
    df = spark.createDataFrame([
        ("r", "assistant", None), ("r", "result", (10, 5, None, 100)), ("r", "result", (20, 5, 8, 0)), ("r", "result", None),
    ], f"run string, type string, usage {usage}")
    totals = U.usage_totals(df)
    assert totals.first()[:] == ("r", 1, 30, 10, 8, 100)
    cost = U.imputed_cost(totals.withColumn("model", F.lit("opus")), price_table(spark)).first().imputed_cost_usd
    assert cost == pytest.approx((30 * 5 + 10 * 25 + 8 * 6.25 + 100 * 0.5) * 1e-6)


def test_call_subjects(spark):
    rows = [({"command": " ls \n -l "},), ({"file_path": "/a/b/c/d.md"},), ({"path": "a/b.md"},), ({"pattern": "x", "path": "/q"},)]
    df = spark.createDataFrame(rows, "p map<string,string>")
    assert [r[0] for r in df.select(U.tool_subject(F.col("p"))).collect()] == ["ls -l", ".../c/d.md", "a/b.md", "x"]


def test_run_id(spark):
    got = spark.sql("select timestamp'2026-07-31 13:32:38' t").select(U.run_id(F.col("t"), F.lit("3f38a9bcc")))
    assert got.first()[0] == "20260731T133238Z-3f38a9b"


def test_truncation(spark):
    rows = [(1, 100, 29.9, False, None), (1, 160, 30.1, False, None), (1, 500, 3.0, True, None), (1, 9, 1.0, False, "timeout")]
    df = spark.createDataFrame(rows, "route int, bytes long, total double, complete boolean, error string")
    assert U.truncation_stats(df, ["route"]).first()[:] == (1, 2, 130, 60, 30.0, 0.2)


# -- documents ---------------------------------------------------------------------

DOC = "# One\ntext\n## Sub ##\nmore\n\n\n```\n# not a heading\n~~~\n```\n# Two\nend\n# One more\n"


def test_sections(spark):
    docs = spark.createDataFrame([("a.md", DOC), ("b.md", "no heading"), ("c.md", "# X\n\n# X\n"), ("d.md", "# X\nall")], "path string, text string")
    got = {tuple(r) for r in T.section_ranges(T.section_index(docs)).filter("path = 'a.md'").collect()}
    assert got == {("a.md", 1, 1, "One", 11), ("a.md", 3, 2, "Sub", 11), ("a.md", 11, 1, "Two", 13), ("a.md", 13, 1, "One more", None)}
    cuts = spark.createDataFrame([("a.md", "Sub"), ("a.md", "Nope"), ("b.md", "X"), ("c.md", "X"), ("d.md", "X"), ("e.md", "X")], "path string, heading string")
    out = {(r.path, r.heading): r for r in T.cut_sections(docs, cuts).collect()}
    assert out["a.md", "Sub"].text == "# One\ntext\n# Two\nend\n# One more\n" and out["a.md", "Sub"].lines_removed == 8
    assert {k: r.error for k, r in out.items()} == {
        ("a.md", "Sub"): None, ("a.md", "Nope"): "no heading", ("b.md", "X"): "no heading", ("c.md", "X"): "repeated heading",
        ("d.md", "X"): "would empty the document", ("e.md", "X"): "no document",
    }


def test_tidy_and_drop(spark):
    docs = spark.createDataFrame([("a", "x\n\n \n\ny  \n\n\n"), ("b", "1\n2\n3")], "path string, text string")
    assert docs.select(T.tidy(F.col("text"))).first()[0] == "x\n\ny  \n"
    left, receipt = T.drop_documents(docs, spark.createDataFrame([("b",)], "path string"))
    assert [r.path for r in left.collect()] == ["a"] and receipt.first()[:] == ("b", 3)


def test_secrets(spark):
    token = "sk-ant-" + "api03-abcdefgh"
    docs = spark.createDataFrame([
        ("t.jsonl", f"one\r\ntwo {token}\n"), ("prose.md", "a refresh token is not a secret; sk-ant- neither"),
        ("c.json", '{"accessToken" : 1, "refreshToken": 2}'), ("half.json", '{"accessToken": 1}'),
        ("a/.env", "x"), ("a/.env.local", "x"), ("k.pem", "x"), (".claude/x", "x"), ("environment.md", "x"),
    ], "path string, text string")
    got = {r.path: (r.line_no, r.problem) for r in T.secret_scan(docs).collect()}
    blocked = (None, "blocked_path")
    assert got == {"t.jsonl": (2, "token"), "c.json": (None, "payload"), "a/.env": blocked, "a/.env.local": blocked,
                   "k.pem": blocked, ".claude/x": blocked}


def test_set_digest(spark):
    import hashlib

    files = {"b.md": "two", "a.md": "one"}
    df = spark.createDataFrame([("s", k, v) for k, v in files.items()], "spec string, path string, text string")
    hashed = df.select("spec", "path", F.sha2("text", 256).alias("sha256"))
    want = hashlib.sha256()
    for name in sorted(files):
        want.update(f"{name}\n{hashlib.sha256(files[name].encode()).hexdigest()}\n".encode())
    assert T.set_digest(hashed, ["spec"]).first().digest == want.hexdigest()[:12]
    assert RECORD_SCHEMA.startswith("type string")


def test_integers_past_64_bits_are_compared_exactly(spark):
    a, b = "123456789012345678901234567890", "123456789012345678901234567891"
    cells = spark.createDataFrame([(a, a), (a, b), ("+00" + a, a), ("-0", "0"), ("9223372036854775808", "9223372036854775807")], "x string, y string")
    got = cells.select(K.matches(K.parse(F.col("x")), K.parse(F.col("y")), F.lit(False)).alias("m")).collect()
    assert [r.m for r in got] == [True, False, True, True, False]


def test_dependencies_of_any_depth(spark):
    chain = [(f"q{k:02d}", [f"q{k - 1:02d}"] if k else []) for k in range(40)]
    questions = spark.createDataFrame(chain, "qid string, depends_on array<string>")
    assert S.transitive_dependencies(questions).count() == 40 * 39 // 2
    grades = spark.createDataFrame([("r", q, "wrong" if q == "q00" else "correct") for q, _ in chain], "run string, qid string, outcome string")
    assert [r.qid for r in S.eligible(grades, questions).collect()] == ["q00"]
    loop = spark.createDataFrame([("a", ["b"]), ("b", ["c"]), ("c", ["a"])], "qid string, depends_on array<string>")
    with pytest.raises(ValueError, match="depends on itself"):
        S.transitive_dependencies(loop)


def test_a_model_without_a_price_keeps_its_row(spark):
    usage = spark.createDataFrame([("r", "unheard-of", 1, 1, 1, 1)], "run string, model string, input_tokens int, output_tokens int, cache_creation_tokens int, cache_read_tokens int")
    assert [r.imputed_cost_usd for r in U.imputed_cost(usage, price_table(spark)).collect()] == [None]


def test_last_seen_keeps_runs_without_a_value(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, ""), ("b", 1, None)], "run string, arrival int, session_id string")
    assert {(r.run, r.session_id) for r in U.last_seen(rows, "session_id").collect()} == {("a", "x"), ("b", None)}


def test_child_calls_beat_under_their_parent(spark):
    rows = [("r", 1, "child", "parent", 30.0), ("r", 2, "parent", None, 61.0), ("r", 3, "child", "parent", 125.0)]
    beats = spark.createDataFrame(rows, "run string, arrival int, tool_use_id string, parent_tool_use_id string, seconds double")
    assert {(r.tool_use_id, r.shown_at) for r in U.heartbeats(beats).collect()} == {("parent", 61.0), ("parent", 125.0)}


def test_assignment_has_the_least_total():
    import itertools

    import numpy as np

    from landledger.functions.pairing import _assignment

    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 6):
        cost = rng.integers(0, 9, (n, n)).astype(float)
        got = _assignment(cost)
        least = min(sum(cost[r, j] for j, r in enumerate(p)) for p in itertools.permutations(range(n)))
        assert sorted(got) == list(range(n)) and sum(cost[r, j] for j, r in enumerate(got)) == least


def test_wide_tables_are_aligned_whatever_their_column_order(spark):
    rng = random.Random(8)
    golden = [[f"g{j}-{rng.randint(0, 10**6)}" for j in range(9)] for _ in range(12)]
    order = [4, 8, 0, 2, 7, 1, 3, 6, 5]
    answer = [[row[j] for j in order] for row in golden]
    answer[3][order.index(6)] = "wrong"
    rng.shuffle(answer)
    tables = spark.createDataFrame([("q", k, r) for k, r in enumerate(golden)], "qid string, row_no int, cells array<string>")
    given = spark.createDataFrame([("r", "q", k, r) for k, r in enumerate(answer)], "run string, qid string, row_no int, cells array<string>")
    asked = spark.createDataFrame([("q", False, [f"c{j}" for j in range(9)])], "qid string, geometry boolean, header array<string>")
    expected = spark.createDataFrame([("r", "q", True)], "run string, qid string, written boolean")
    (row,) = Q.grade(expected, given, tables, asked).collect()
    assert row.outcome == "wrong"
    assert [(d.row, d.column, d.golden, d.answer) for d in row.diffs] == [(3, "c6", golden[3][6], "wrong")]
