"""Transcripts followed as a stream, in whatever order and however late their records come.

A session appends to its transcript while it runs, and Spark's file source reads a file once. ``land`` therefore lists
the transcripts again and again and writes the lines that are new and complete as segments; ``follow`` streams these.

No operator drops late records. State is small and kept: a list of marks for each call that beats, and a row for each
call. Streams run in update mode: a later row of a key replaces the earlier ones, see ``latest``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from landledger.operators.usage import HEARTBEAT_SECONDS
from landledger.sources.files import open_file
from landledger.sources.runs import RECORD_SCHEMA

SEGMENT = "run string, file string, start bigint, stop bigint, value string"
#: Bytes read at a time.
CHUNK = 1 << 20


def _new_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete lines of each file from an offset on; a half-written last line is left for the next time."""
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            parts = path.split("/")
            run, at, rest = "/".join(parts[-3:-1]), start, b""
            with open_file(path) as file:
                file.seek(start)
                while chunk := file.read(CHUNK):
                    *lines, rest = (rest + chunk).split(b"\n")
                    rows = []
                    for line in lines:
                        rows.append((run, path, at, at + len(line) + 1, line.decode("utf-8", "replace")))
                        at += len(line) + 1
                    if rows:
                        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["run", "file", "start", "stop", "value"])


def land(spark: SparkSession, source: str, landing: str) -> None:
    """Append what the transcripts ``<source>/<model>/<run>/transcript.jsonl`` have gained since the last call."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "transcript.jsonl").load(source)
    spark.createDataFrame([], SEGMENT).write.mode("append").parquet(landing)
    read = spark.read.schema(SEGMENT).parquet(landing).groupBy("file").agg(F.max("stop").alias("start"))
    grown = (
        listed.select("path", "length").join(read, F.col("path") == F.col("file"), "left")
        .select("path", F.coalesce("start", F.lit(0).cast("bigint")).alias("start"), "length").filter("length > start")
    )
    grown.select("path", "start").mapInArrow(_new_lines, SEGMENT).write.mode("append").parquet(landing)


def follow(spark: SparkSession, landing: str, files_per_trigger: int = 1000) -> DataFrame:
    """Records of the landed lines; ``run`` is the folder, ``arrival`` the place in the file. Lines that are no record are left out."""
    lines = spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
    parsed = lines.select("run", F.col("start").alias("arrival"), F.from_json("value", RECORD_SCHEMA).alias("r"))
    return parsed.filter(F.col("r.type").isNotNull()).select("run", "arrival", "r.*")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last version of each key of an update stream's rows."""
    rest = [c for c in rows.columns if c not in keys]
    version = F.struct(F.col(order).alias("_order"), *rest)
    return rows.groupBy(*keys).agg(F.max(version).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def call_maxima(records: DataFrame, window: str = "1 day") -> DataFrame:
    """Longest heartbeat per call and day, the first of the two aggregations behind tool totals."""
    beats = records.filter(F.col("elapsed_time_seconds").isNotNull() & F.col("tool_use_id").isNotNull())
    return (
        beats.groupBy(F.window("ts", window), "run", "tool_use_id")
        .agg(F.max(F.struct("elapsed_time_seconds", "tool_name")).alias("top"))
        .select(
            F.col("window.start").alias("day"), "run", "tool_use_id",
            F.coalesce("top.tool_name", F.lit("unknown")).alias("tool"),
            F.col("top.elapsed_time_seconds").alias("seconds"),
        )
    )


def upsert_maxima(table: str):
    """foreachBatch writer: each batch lands as its own folder, so a replay replaces itself.

    A call's seconds only grow, so the max over all batches is the current value.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    return write


def tool_totals(spark: SparkSession, table: str) -> DataFrame:
    """Seconds per run and tool over all batches written so far."""
    calls = spark.read.parquet(table).groupBy("run", "tool_use_id").agg(
        F.max(F.struct("seconds", "tool")).alias("top")
    )
    return calls.groupBy("run", F.col("top.tool").alias("tool")).agg(
        F.count("*").alias("slow_tool_calls"), F.round(F.sum("top.seconds"), 1).alias("slow_tool_seconds")
    )


def usage_stream(records: DataFrame, window: str = "1 hour") -> DataFrame:
    """Turns and tokens per run and hour; late records still count."""
    result = F.col("type") == "result"

    def spent(field: str):
        return F.sum(F.when(result, F.coalesce(F.col(f"usage.{field}"), F.lit(0))).otherwise(0)).alias(field)

    return records.groupBy(F.window("ts", window), "run").agg(
        F.count_if(F.col("type") == "assistant").alias("turns"), spent("input_tokens"), spent("output_tokens"),
    )


PAIR = "run string, call_id string, tool string, started double, ended double, failed boolean, seconds double"


def _pair(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tool, started, ended, failed = state.get if state.exists else (None, None, None, None)
    for rows in batches:
        for r in rows.itertuples():
            if r.is_call:
                tool, started = r.tool, min(r.at, r.at if started is None else started)
            else:
                ended, failed = (r.at, bool(r.failed)) if ended is None or r.at < ended else (ended, failed)
    state.update((tool, started, ended, failed))
    if started is not None:
        seconds = None if ended is None else ended - started
        yield pd.DataFrame({"run": [key[0]], "call_id": [key[1]], "tool": [tool], "started": [started], "ended": [ended],
                            "failed": [failed], "seconds": [seconds]}).astype({"ended": "float64", "seconds": "float64"})


def call_durations(records: DataFrame) -> DataFrame:
    """Calls as they begin, with nulls, and again once their result is there, however long that takes."""
    blocks = records.select("run", "ts", F.explode("message.content").alias("b"))
    is_call = F.col("b.type") == "tool_use"
    marks = blocks.filter(F.col("b.type").isin("tool_use", "tool_result")).select(
        "run", F.when(is_call, F.col("b.id")).otherwise(F.col("b.tool_use_id")).alias("call_id"), is_call.alias("is_call"),
        F.coalesce("b.name", F.lit("?")).alias("tool"), F.col("ts").cast("double").alias("at"),
        F.coalesce("b.is_error", F.lit(False)).alias("failed"),
    )
    return marks.groupBy("run", "call_id").applyInPandasWithState(
        _pair, PAIR, "tool string, started double, ended double, failed boolean", "update", GroupStateTimeout.NoTimeout
    )


def open_calls(pairs: DataFrame, now: float) -> DataFrame:
    """(run, call_id, tool, running_for) of calls without a result; ``pairs`` are the stream's rows so far, ``now`` in seconds."""
    rows = pairs.withColumn("_known", F.col("ended").isNotNull().cast("int"))
    return latest(rows, ["run", "call_id"], "_known").filter(F.col("ended").isNull()).select(
        "run", "call_id", "tool", (F.lit(now) - F.col("started")).alias("running_for")
    )


BEATS = "run string, tool_use_id string, n_marks long, shown array<double>"


def _show_beats(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    times, seconds = map(list, state.get) if state.exists else ([], [])
    for rows in batches:
        times += rows["arrival"].tolist()
        seconds += rows["seconds"].tolist()
    order = sorted(range(len(times)), key=lambda k: (times[k], seconds[k]))
    times, seconds = [times[k] for k in order], [seconds[k] for k in order]
    shown, last = [], 0.0
    for mark in seconds:
        if mark - last >= HEARTBEAT_SECONDS:
            last = mark
            shown.append(last)
    state.update((times, seconds))
    yield pd.DataFrame({"run": [key[0]], "tool_use_id": [key[1]], "n_marks": [len(times)], "shown": [shown]})


def heartbeat_stream(records: DataFrame) -> DataFrame:
    """The pulses of each running call, one a minute, told anew whenever the call beats.

    A call's marks are put in the order of the transcript, so the order in which files are read does not matter.
    """
    beats = records.filter(F.col("type") == "tool_progress").select(
        "run", "arrival",
        F.coalesce("parent_tool_use_id", "tool_use_id").alias("tool_use_id"),
        F.coalesce("elapsed_time_seconds", F.lit(0.0)).alias("seconds"),
    )
    return beats.groupBy("run", "tool_use_id").applyInPandasWithState(
        _show_beats, BEATS, "arrivals array<bigint>, seconds array<double>", "update", GroupStateTimeout.NoTimeout
    )
