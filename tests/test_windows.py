"""Windows over a table and over a stream: file order, late records, state."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from landledger.streaming import windows as W

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
KINDS = {
    "tumbling": lambda e: W.tumbling(e, "1 hour", ["event_type"], "8 days"),
    "sliding": lambda e: W.sliding(e, "1 day", "6 hours", ["event_type"], "8 days"),
    "sessions": lambda e: W.sessions(e, "6 hours", ["user_id"], "8 days"),
}
FAR = dt.datetime(2030, 1, 1)


def told(rows):
    return sorted((r.opened, r.closed, r[2], r.events, r.unvalued, round(r.value or 0, 6), r.most) for r in rows if r.opened.year < 2029)


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    """One event far in the future to close all windows, and all events."""
    root = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    spark.createDataFrame([(-1, FAR, -1, "end", 0.0, "")], SCHEMA).coalesce(1).write.parquet(str(root / "c7"))
    return root, events


def run(spark, folder, order, chunks, kind):
    """Files handed over one at a time in the given order; rows told in append mode."""
    out = []
    (folder / "in").mkdir()
    stream = KINDS[kind](spark.readStream.schema(SCHEMA).parquet(str(folder / "in")))
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(folder / "cp")).foreachBatch(lambda b, _: out.extend(b.collect())).start()
    try:
        for k in order:
            (file,) = chunks.glob(f"c{k}/*.parquet")
            shutil.copy(file, folder / "in" / f".{k}.tmp")
            (folder / "in" / f".{k}.tmp").rename(folder / "in" / f"{k}.parquet")
            query.processAllAvailable()
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()
    return out, left


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_stream_tells_what_the_table_has_in_any_order_of_files(spark, tmp_path, chunks, kind):
    root, events = chunks
    # of one week, so that no record is further behind than the watermark allows
    week = events.where("ts < '2024-01-08'")
    expected = told(KINDS[kind](week).collect())
    assert expected
    part = tmp_path / "week"
    lot = F.pmod(F.datediff("ts", F.lit("2024-01-01")), F.lit(7))
    for k in range(7):
        week.where(lot == k).coalesce(1).write.parquet(str(part / f"c{k}"))
    shutil.copytree(root / "c7", part / "c7")
    for n, order in enumerate(([0, 1, 2, 3, 4, 5, 6, 7], [5, 0, 6, 2, 4, 1, 3, 7])):
        folder = tmp_path / str(n)
        folder.mkdir()
        rows, left = run(spark, folder, order, part, kind)
        assert told(rows) == expected
        assert left <= 4  # what the last event opened: all else is gone


def test_record_behind_the_watermark_is_dropped_and_state_freed(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    lots = [[(1, base, 1, "a", 1.0, "")], [(2, base + dt.timedelta(days=20), 1, "a", 1.0, "")], [(3, base, 1, "a", 1.0, "")], [(4, FAR, 1, "a", 1.0, "")]]
    for k, lot in enumerate(lots):
        spark.createDataFrame(lot, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "lots" / f"c{k}"))
    folder = tmp_path / "run"
    folder.mkdir()
    rows, left = run(spark, folder, range(4), tmp_path / "lots", "tumbling")
    assert [(r.opened, r.events) for r in sorted(rows, key=lambda r: r.opened)] == [(base, 1), (base + dt.timedelta(days=20), 1)]
    assert left == 1


def test_sessions_meet_at_the_gap_and_nulls_count(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(minutes=m), u, "a", v, "") for k, (m, u, v) in enumerate([(0, 1, 2.0), (59, 1, None), (118, 1, 4.0), (179, 1, 1.0), (0, 2, None)])]
    got = sorted(tuple(r) for r in W.rates(W.sessions(spark.createDataFrame(rows, SCHEMA), "1 hour", ["user_id"])).collect())
    hour = dt.timedelta(hours=1)
    assert [(g[0], g[1], g[2], g[3], g[4]) for g in got] == [
        (base, base + hour, 2, 1, 1), (base, base + dt.timedelta(minutes=178), 1, 3, 1), (base + dt.timedelta(minutes=179), base + dt.timedelta(minutes=239), 1, 1, 0)]
    assert [g[-1] for g in got] == [None, 3.0, 1.0]


def test_no_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert all(kind(none).collect() == [] for kind in KINDS.values())
