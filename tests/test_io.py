import json
import os
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landledger.functions import geometry as G
from landledger.functions.wkb import from_wkb
from landledger.operators import grading as Q
from landledger.plans.stages import Stages
from landledger.sources import files, lists, runs, tables
from landledger.streaming import transcripts as ST


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_three_list_encodings_agree(spark):
    root = folder()
    box = "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 1.0, 0.0 0.0))"
    put(f"{root}/list.csv", f'cod_imovel,municipio,cod_estado,geometry\nGO-1-A,M,GO,\n,,,"{box}"\nGO-1-B,M,GO,\n')
    rows = lists.read_list(spark, "csv", f"{root}/list.csv").orderBy("row_id").collect()
    assert [(r.raw_id, r.raw_wkt) for r in rows] == [("GO-1-A", None), (None, box), ("GO-1-B", None)]
    shaped = spark.createDataFrame([("GO-1-A", box), ("GO-1-B", box), ("", "POINT (3.0 4.0)")], "cod_imovel string, wkt string")
    shaped = shaped.coalesce(1).withColumn("geometry", G.from_wkt(F.col("wkt"))).drop("wkt")
    tables.write_shapes(shaped, f"{root}/list.parquet")
    rows = lists.read_list(spark, "geometry", f"{root}/list.parquet").orderBy("row_id").collect()
    assert [(r.raw_id, r.raw_wkt) for r in rows] == [("GO-1-A", box), ("GO-1-B", box), ("", "POINT (3.0 4.0)")]
    rows = lists.read_list(spark, "split", f"{root}/list.csv", f"{root}/list.parquet").orderBy("row_id").collect()
    assert [(r.raw_id, r.raw_wkt) for r in rows] == [("GO-1-A", box), (None, box), ("GO-1-B", box)]


def test_every_shape_of_an_id_is_a_row(spark):
    root = folder()
    put(f"{root}/list.csv", "cod_imovel\nA\nB\nC\n")
    shaped = spark.createDataFrame([("A", "POINT (1.0 2.0)"), ("A", "POINT (3.0 4.0)"), ("B", "POINT (5.0 6.0)")], "cod_imovel string, wkt string")
    tables.write_shapes(shaped.withColumn("geometry", G.from_wkt(F.col("wkt"))).drop("wkt"), f"{root}/shapes")
    rows = lists.read_list(spark, "split", f"{root}/list.csv", f"{root}/shapes").collect()
    assert sorted((r.raw_id, r.raw_wkt or "") for r in rows) == [("A", "POINT (1.0 2.0)"), ("A", "POINT (3.0 4.0)"), ("B", "POINT (5.0 6.0)"), ("C", "")]
    assert len({r.row_id for r in rows}) == 4


def test_geojson_lists(spark):
    root = folder()
    shapes = [{"type": "Point", "coordinates": [3, 4.5]}, {"type": "Polygon", "coordinates": [[[0, 0, 9], [1, 0, 9], [1, 1, 9], [0, 0, 9]]]},
              {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}, None]
    features = [{"type": "Feature", "properties": {"cod_imovel": f"id{k}", "other": k}, "geometry": g} for k, g in enumerate(shapes)]
    put(f"{root}/all.geojson", json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    put(f"{root}/lines.geojsonl", "".join(json.dumps(f) + "\n" for f in features))
    for mode, path in (("geojson", "all.geojson"), ("geojsonl", "lines.geojsonl")):
        rows = lists.read_list(spark, mode, f"{root}/{path}").orderBy("row_id")
        got = rows.select("raw_id", G.to_wkt(G.from_wkt(F.col("raw_wkt"))).alias("wkt")).collect()
        assert [tuple(r) for r in got] == [
            ("id0", "POINT (3.0 4.5)"), ("id1", "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0))"),
            ("id2", "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0)), ((5.0 5.0, 6.0 5.0, 6.0 6.0, 5.0 5.0)))"), ("id3", None)], mode


def test_cells_with_line_breaks(spark):
    root = folder()
    put(f"{root}/list.csv", 'cod_imovel,geometry\n"A\nB","POINT\n(1 2)"\nC,\n')
    rows = lists.read_list(spark, "csv", f"{root}/list.csv").orderBy("row_id").collect()
    assert [(r.raw_id, r.raw_wkt) for r in rows] == [("A\nB", "POINT\n(1 2)"), ("C", None)]
    put(f"{root}/golden/q01.csv", 'a,b\n"x, ""y""\nz",1\n\n,2\n')
    body, headers = runs.read_golden(spark, f"{root}/golden")
    assert headers.collect()[0][:] == ("q01", ["a", "b"])
    assert [r.cells for r in body.orderBy("row_no").collect()] == [['x, "y"\nz', "1"], ["", "2"]]


def test_files_that_a_task_leaves_unfinished_are_hidden():
    root = folder()

    def given():
        yield pa.RecordBatch.from_pydict({"path": [f"{root}/a.json", f"{root}/b.json"], "line": ["{}", "{}"]})
        raise OSError("the executor is lost")

    with pytest.raises(OSError):
        list(files._write_lines(given()))
    assert [n for n in os.listdir(root) if not n.startswith(".")] == ["a.json"]


def test_binary_shapes_of_all_sorts(spark):
    import struct

    line = struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)
    raised = struct.pack("<BI3d", 1, 1001, 1, 2, 3)
    labelled = struct.pack("<BII2d", 1, 1 | 0x20000000, 4326, 7, 8)
    nothing = struct.pack("<BI2d", 1, 1, float("nan"), float("nan"))
    ring = struct.pack("<BIII9d", 1, 1003, 1, 3, 0, 0, 9, 1, 0, 9, 0, 0, 9)
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate((line, raised, labelled, nothing, ring))], "k int, b binary")
    got = rows.select("k", G.to_wkt(from_wkb("b")).alias("wkt")).orderBy("k").collect()
    assert [r.wkt for r in got] == [None, "POINT (1.0 2.0)", "POINT (7.0 8.0)", None, "POLYGON ((0.0 0.0, 1.0 0.0, 0.0 0.0))"]


def test_parcels_keep_a_key_per_row(spark):
    root = folder()
    src = spark.createDataFrame([("A", "POINT (1 2)"), ("A", "POINT (1 2)")], "cod_imovel string, wkt string")
    shaped = src.withColumn("geometry", G.from_wkt(F.col("wkt"))).drop("wkt")
    tables.write_shapes(shaped, f"{root}/p")
    out = tables.read_parcels(spark, f"{root}/p")
    assert out.select("row_key").distinct().count() == 2 and out.first().xmin == 1.0
    tables.index_shapes(shaped, f"{root}/i", 0.5)
    again = tables.read_shapes(spark, f"{root}/i", ["cod_imovel", "cell_x"])
    assert again.first().cell_x == 2 and again.first().geometry.kind == "POINT"


def test_csv_sink_and_manifest(spark):
    root = folder()
    df = spark.createDataFrame([(1, True, None), (2, False, "x")], "a int, b boolean, c string").coalesce(1)
    tables.write_answer_csv(df, f"{root}/out", ["a", "b", "c"])
    (name,) = [n for n in os.listdir(f"{root}/out") if n.endswith(".csv")]
    assert open(f"{root}/out/{name}").read() == "a,b,c\n1,True,\n2,False,x\n"
    got = tables.checksum_manifest(spark, f"{root}/out").filter(F.col("name").endswith(".csv")).first()
    import hashlib

    assert got.sha256 == hashlib.sha256(b"a,b,c\n1,True,\n2,False,x\n").hexdigest()


def test_rewritten_input_has_stages_of_its_own(spark):
    root = folder()
    spark.range(3).write.parquet(f"{root}/t.parquet")

    def counted():
        return Stages.of(spark, root).table("n", lambda: spark.read.parquet(f"{root}/t.parquet").selectExpr("count(*) AS n")).first().n

    assert (counted(), counted()) == (3, 3)
    spark.range(5).write.mode("overwrite").parquet(f"{root}/t.parquet")
    assert counted() == 5
    stages = Stages.of(spark, root)
    one, two = (stages.keep("k", spark.range(n)).count() for n in (1, 2))
    assert (one, two) == (1, 2)


def test_run_folders_grade_end_to_end(spark):
    root = folder()
    put(f"{root}/golden/q01.csv", "name,n\na,1\nb,2\n")
    put(f"{root}/golden/q02.csv", 'text\n"x, ""y"""\n')
    for run, answers in {"r1": {"q01": "n,name\n2,B\n1,A\n", "q02": 'v\n"x, ""y"""\n'}, "r2": {"q01": "a\n1,2\n3\n"}}.items():
        put(f"{root}/results/opus/{run}/meta.json", json.dumps({"model": "opus", "run_id": run, "ablation": {"arm": "cut"}}, indent=1))
        for qid, text in answers.items():
            put(f"{root}/results/opus/{run}/answers/{qid}.csv", text)
    put(f"{root}/q.json", '{"id": "01", "stage": 1}\n{"id": "02", "stage": 2, "depends_on": ["01"], "grading": "geometry"}\n')
    meta = runs.read_meta(spark, f"{root}/results")
    assert [(r.run, r.arm, r.status) for r in meta.collect()] == [("opus/r1", "cut", None), ("opus/r2", "cut", None)]
    golden, headers = runs.read_golden(spark, f"{root}/golden")
    answers, written = runs.read_answers(spark, f"{root}/results")
    spec = runs.read_questions(spark, f"{root}/q.json")
    assert spec.orderBy("qid").collect()[1][:] == ("q02", 2, ["q01"], True)
    asked = meta.select("run", F.explode(F.array(F.lit("q01"), F.lit("q02"))).alias("qid"))
    expected = asked.join(written.withColumn("w", F.lit(True)), ["run", "qid"], "left").select(
        "run", "qid", F.coalesce("w", F.lit(False)).alias("written")
    )
    out = Q.grade(expected, answers, golden, spec.join(headers, "qid").select("qid", "geometry", "header"))
    got = {(r.run, r.qid): r.outcome for r in out.collect()}
    assert got == {("opus/r1", "q01"): "correct", ("opus/r1", "q02"): "correct",
                   ("opus/r2", "q01"): "unparseable", ("opus/r2", "q02"): "missing"}


def beat(run, call, seconds, minute, tool="Bash"):
    return {"type": "tool_progress", "session_id": run, "tool_use_id": call, "tool_name": tool,
            "elapsed_time_seconds": seconds, "ts": f"2026-01-01T00:{minute:02d}:00Z"}


def block(run, minute, **b):
    return {"type": "assistant", "session_id": run, "ts": f"2026-01-01T00:{minute:02d}:00Z", "message": {"content": [b]}}


def test_transcripts_tolerate_a_half_line(spark):
    root = folder()
    lines = [json.dumps(beat("s", "a", 30.0, 1)), json.dumps({"type": "assistant"}), '{"type": "resu']
    put(f"{root}/opus/r1/transcript.jsonl", "\n".join(lines))
    got = runs.read_transcripts(spark, root).orderBy("arrival").collect()
    assert [(r.run, r.type) for r in got] == [("opus/r1", "tool_progress"), ("opus/r1", "assistant")]


class Stream:
    """Two parts of a session's transcript, landed one after the other, in either order of reading."""

    def __init__(self, spark, order):
        self.spark, self.root = spark, folder()
        first = [beat("s", "a", 30.0, 1), beat("s", "a", 70.0, 2), beat("s", "b", 20.0, 2, "Read"),
                 block("s", 1, type="tool_use", id="a", name="Bash"), block("s", 3, type="tool_use", id="open", name="Read")]
        second = [beat("s", "a", 100.0, 3), beat("s", "a", 131.0, 4), block("s", 59, type="tool_result", tool_use_id="a", is_error=True)]
        path = f"{self.root}/runs/opus/r1/transcript.jsonl"
        text = "".join(json.dumps(r) + "\n" for r in first)
        put(path, text + '{"type": "tool_pro')  # the session is writing its next line
        ST.land(spark, f"{self.root}/runs", f"{self.root}/landed")
        put(path, text + "".join(json.dumps(r) + "\n" for r in second) + '{"half')
        ST.land(spark, f"{self.root}/runs", f"{self.root}/landed")
        ST.land(spark, f"{self.root}/runs", f"{self.root}/landed")
        files = sorted((p for p in os.listdir(f"{self.root}/landed") if p.endswith(".parquet")), key=lambda p: os.path.getmtime(f"{self.root}/landed/{p}"))
        for k, p in enumerate(files if order == "as written" else files[::-1]):
            os.utime(f"{self.root}/landed/{p}", (1_700_000_000 + 60 * k,) * 2)
        self.records = ST.follow(spark, f"{self.root}/landed", files_per_trigger=1)

    def run(self, df, name, writer=None):
        sink = df.writeStream.outputMode("update").option("checkpointLocation", f"{self.root}/cp-{name}")
        sink = sink.foreachBatch(writer) if writer else sink.format("memory").queryName(name)
        q = sink.trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return None if writer else self.spark.table(name)


@pytest.fixture(params=["as written", "reversed"])
def stream(spark, request):
    return Stream(spark, request.param)


def test_growing_transcript_lands_each_line_once(spark, stream):
    rows = spark.read.parquet(f"{stream.root}/landed").orderBy("start").collect()
    assert [(r.run, r.stop) for r in rows][-1] == ("opus/r1", rows[-1].start + len(rows[-1].value) + 1)
    assert len(rows) == 8 and [r.start for r in rows] == [0, *[r.stop for r in rows][:-1]]


def test_heartbeats_as_a_stream(stream):
    shown = ST.latest(stream.run(ST.heartbeat_stream(stream.records), "beats"), ["run", "tool_use_id"], "n_marks")
    assert {(r.run, r.tool_use_id): r.shown for r in shown.collect()} == {("opus/r1", "a"): [70.0, 131.0], ("opus/r1", "b"): []}


def test_tool_totals_as_a_stream(spark, stream):
    stream.run(ST.call_maxima(stream.records), "maxima", ST.upsert_maxima(f"{stream.root}/maxima"))
    totals = {r.tool: (r.slow_tool_calls, r.slow_tool_seconds) for r in ST.tool_totals(spark, f"{stream.root}/maxima").collect()}
    assert totals == {"Bash": (1, 131.0), "Read": (1, 20.0)}


def test_late_results_pair_as_a_stream(stream):
    pairs = stream.run(ST.call_durations(stream.records), "pairs")
    done = pairs.filter("seconds is not null").collect()
    assert [(r.call_id, r.tool, r.seconds, r.failed) for r in done] == [("a", "Bash", 58 * 60.0, True)]
    now = pairs.agg(F.max("started")).first()[0] + 90
    assert [(r.call_id, r.tool, r.running_for) for r in ST.open_calls(pairs, now).collect()] == [("open", "Read", 90.0)]


def test_usage_as_a_stream(stream):
    usage = stream.run(ST.usage_stream(stream.records), "usage").groupBy("run").agg(F.max("turns")).first()
    assert usage[:] == ("opus/r1", 3)
