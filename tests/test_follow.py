"""Growing files as a source of their own, restarts, and calls watched with timers."""

import json
import os
import random
import time

import pytest
from pyspark.sql import Row

from landledger.streaming import tail, watch


def stamp(second):
    return f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z"


def block(second, **content):
    return {"type": "assistant" if content["type"] == "tool_use" else "user", "ts": stamp(second), "message": {"content": [content]}}


def beat(call, elapsed, second, parent=None):
    return {"type": "tool_progress", "tool_use_id": call, "parent_tool_use_id": parent, "tool_name": "Bash", "elapsed_time_seconds": elapsed, "ts": stamp(second)}


def grow(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(text)


@pytest.mark.parametrize("seed", range(5))
def test_ranges_hold_each_line_once_wherever_they_are_cut(tmp_path, seed):
    rng = random.Random(seed)
    lines = [b"x" * rng.choice([0, 1, 5, 300, 70_000]) + b"\xc3\xa9" for _ in range(40)]
    path = tmp_path / "f"
    path.write_bytes(b"".join(x + b"\n" for x in lines) + b"half")
    size = path.stat().st_size
    cuts = sorted({0, size, *(rng.randint(0, size) for _ in range(rng.choice([0, 3, 40])))})
    got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in tail.lines_of(f"file://{path}", a, b, chunk=rng.choice([1 << 20, 1000]))]
    assert [line for _, _, line in got] == lines
    assert [start for start, _, _ in got] == [0, *[stop for _, stop, _ in got]][:-1]


def drained(query, seconds=60):
    query.processAllAvailable()
    assert query.exception() is None


def test_growing_files_are_read_once_by_the_stream_alone(spark, tmp_path):
    source, out, cp = tmp_path / "runs", str(tmp_path / "out"), str(tmp_path / "cp")
    first, second = source / "opus" / "r1" / "transcript.jsonl", source / "haiku" / "r2" / "transcript.jsonl"
    expected = []

    def write(path, n):
        for _ in range(n):
            expected.append(f"{len(expected)} " + "é" * (len(expected) % 50))
            grow(path, expected[-1] + "\n")

    def start():
        return tail.growing_lines(spark, f"{source}/*/*/transcript.jsonl", split_bytes=200).writeStream.format("parquet").option("checkpointLocation", cp).start(out)

    write(first, 30)
    grow(first, "half a ")
    query = start()
    drained(query)
    grow(first, "line\n")
    expected.append("half a line")
    write(second, 20)
    drained(query)
    query.stop()
    write(first, 15)  # while nothing runs
    write(second, 1)
    query = start()
    drained(query)
    drained(query)
    write(second, 9)
    grow(source / "opus" / "r1" / "other.jsonl", "no transcript\n")
    drained(query)
    query.stop()
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == sorted(expected)


def test_records_of_transcripts(spark, tmp_path):
    path = tmp_path / "opus" / "r1" / "transcript.jsonl"
    grow(path, json.dumps(beat("a", 5.0, 1)) + "\nno record\n{}\n" + json.dumps(block(2, type="tool_use", id="a", name="Bash")) + "\n")
    query = tail.follow_transcripts(spark, str(tmp_path)).writeStream.format("memory").queryName("followed").start()
    drained(query)
    query.stop()
    rows = spark.table("followed").orderBy("arrival").collect()
    assert [(r.run, r.type) for r in rows] == [("opus/r1", "tool_progress"), ("opus/r1", "assistant")] and rows[0].arrival == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, watch.STATE_STORE)
    yield
    spark.conf.set(key, before)


def test_calls_are_told_while_they_run_and_forgotten_after(spark, tmp_path, rocks):
    path = tmp_path / "runs" / "opus" / "r1" / "transcript.jsonl"
    told = []

    def put(*records):
        grow(path, "".join(json.dumps(r) + "\n" for r in records))

    def until(what, seconds=90):
        end = time.time() + seconds
        while not what() and time.time() < end:
            assert query.exception() is None
            time.sleep(0.3)
        assert what()

    def seen(event, call):
        return [r for r in told if r.event == event and r.call_id == call]

    put(block(0, type="tool_use", id="a", name="Bash"), beat("a", 30.0, 30), beat("a", 70.0, 70), beat("x", 75.0, 75, parent="a"),
        block(80, type="tool_result", tool_use_id="late", is_error=True))
    records = tail.follow_transcripts(spark, str(tmp_path / "runs"))
    sink = watch.watch_calls(records, pulse=1.0).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    query = sink.foreachBatch(lambda batch, _: told.extend(batch.collect())).start()
    try:
        until(lambda: len(seen("running", "a")) >= 2)  # by its timer, with nothing new in the file
        assert [r.seconds for r in seen("beat", "a")] == [70.0] and not seen("ended", "a")
        first, again = [r.seconds for r in seen("running", "a")[:2]]
        assert again > first
        put(beat("a", 100.0, 100), beat("a", 131.0, 131), block(140, type="tool_result", tool_use_id="a", is_error=False))
        put(block(20, type="tool_use", id="late", name="Read"))  # its result came before
        until(lambda: seen("ended", "a") and seen("ended", "late"))
        assert [r.seconds for r in seen("beat", "a")] == [70.0, 131.0]
        assert [(r.tool, r.seconds, r.failed) for r in seen("ended", "a") + seen("ended", "late")] == [("Bash", 140.0, False), ("Read", 60.0, True)]
        many = len(seen("running", "a"))
        time.sleep(3)
        until(lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)
        assert len(seen("running", "a")) == many
    finally:
        query.stop()


def test_calls_of_a_run_share_a_few_states(spark, tmp_path, rocks):
    path = tmp_path / "runs" / "opus" / "r1" / "transcript.jsonl"
    told, n = [], 300
    grow(path, "".join(json.dumps(block(k % 60, type="tool_use", id=f"c{k}", name=f"T{k % 3}")) + "\n" for k in range(n)))
    records = tail.follow_transcripts(spark, str(tmp_path / "runs"))
    sink = watch.watch_calls(records, pulse=3600.0).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    query = sink.foreachBatch(lambda batch, _: told.extend(batch.collect())).start()

    def until(what, seconds=90):  # timers keep such a query from ever being drained
        end = time.time() + seconds
        while not what() and time.time() < end:
            assert query.exception() is None
            time.sleep(0.3)
        assert what()

    try:
        until(lambda: len(told) >= n and any(p["stateOperators"] and p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress))
        assert sorted((r.call_id, r.tool) for r in told if r.event == "started") == sorted((f"c{k}", f"T{k % 3}") for k in range(n))
        rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert 0 < max(rows) <= watch.SHARES * 3  # a state, its timer and its place in the order of timers; one row or more a call before
        grow(path, "".join(json.dumps(block(100 + k, type="tool_result", tool_use_id=f"c{k}", is_error=k % 2 == 1)) + "\n" for k in range(n)))
        until(lambda: len([r for r in told if r.event == "ended"]) >= n)
        assert sorted((r.call_id, r.seconds, r.failed) for r in told if r.event == "ended") == sorted((f"c{k}", 100.0 + k - k % 60, k % 2 == 1) for k in range(n))
        until(lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)
    finally:
        query.stop()


class Held:
    """A handle with one group's state and timers."""

    def __init__(self):
        self.value, self.timers, self.now = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def listTimers(self):
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_each_call_of_a_group_is_told_and_forgotten_in_its_own_time():
    held, told = Held(), []
    group = watch.CallWatch(pulse=10.0, forget=60_000)
    group.init(held)

    def tell(second, rows):
        for r in rows:
            told.extend((second, *e) for e in zip(r.event, r.call_id, r.seconds, strict=True))

    def mark(second, call, kind):
        held.now = second * 1000
        row = Row(arrival=[second], call_id=[call], kind=[kind], tool=["T"], at=[float(second)], elapsed=[None], failed=[False])
        tell(second, group.handleInputRows(("r", 0), iter([row]), held))

    def pass_to(second):
        while held.timers and min(held.timers) <= second * 1000:
            at = min(held.timers)
            held.now = at
            tell(at // 1000, group.handleExpiredTimer(("r", 0), held, None))
            held.deleteTimer(at)

    mark(0, "a", "call")
    mark(3, "orphan", "result")
    mark(4, "b", "call")
    pass_to(25)
    mark(25, "a", "result")
    pass_to(30)
    assert told == [
        (0, "started", "a", None), (4, "started", "b", None), (10, "running", "a", 10.0), (14, "running", "b", 10.0),
        (20, "running", "a", 20.0), (24, "running", "b", 20.0), (25, "ended", "a", 25.0),
    ]
    del told[:]
    pass_to(200)  # b has had no mark for a minute at 64
    assert told == [(s, "running", "b", s - 4.0) for s in (34, 44, 54)] and held.value is None and not held.timers
    mark(201, "b", "result")
    assert not told[3:] and not held.timers
