"""Tokens, cost and time from session transcripts, and statistics of truncated reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.plans.skew import exact_median
from landledger.policy import CACHE_READ_FACTOR, CACHE_WRITE_FACTOR

# A call at or above this many seconds was killed; one pulse per this many seconds.
TOOL_TIMEOUT_SECONDS = 120
HEARTBEAT_SECONDS = 60

# Usage field of a result record and the name it is reported under.
USAGE_FIELDS = {
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cache_creation_input_tokens": "cache_creation_tokens",
    "cache_read_input_tokens": "cache_read_tokens",
}
# Keys of a call's input that say what it is about, in order of preference.
SUBJECT_KEYS = ["command", "file_path", "pattern", "path", "prompt"]


def usage_totals(records: DataFrame) -> DataFrame:
    """Turns and tokens per run; every result record spent real tokens, so they are summed."""
    result = F.col("type") == "result"
    sums = [
        F.sum(F.when(result, F.coalesce(F.col(f"usage.{field}"), F.lit(0))).otherwise(0)).alias(name)
        for field, name in USAGE_FIELDS.items()
    ]
    return records.groupBy("run").agg(F.count_if(F.col("type") == "assistant").alias("turns"), *sums)


def imputed_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Token counts at list price; ``usage`` carries a model column. A model without a price keeps its row, with no cost."""
    cost = (
        F.col("input_tokens") * F.col("input_per_mtok")
        + F.col("output_tokens") * F.col("output_per_mtok")
        + F.col("cache_creation_tokens") * F.col("input_per_mtok") * CACHE_WRITE_FACTOR
        + F.col("cache_read_tokens") * F.col("input_per_mtok") * CACHE_READ_FACTOR
    ) * 1e-6
    return usage.join(prices, "model", "left").withColumn("imputed_cost_usd", cost).drop(
        "input_per_mtok", "output_per_mtok"
    )


def longest_calls(records: DataFrame) -> DataFrame:
    """Longest heartbeat per call, with the tool named on the first record that reached it."""
    beats = records.filter(F.col("elapsed_time_seconds").isNotNull() & F.col("tool_use_id").isNotNull())
    top = F.struct(
        F.col("elapsed_time_seconds").cast("double").alias("seconds"),
        (-F.col("arrival")).alias("first"),
        F.coalesce(F.nullif("tool_name", F.lit("")), F.lit("unknown")).alias("tool"),
    )
    return beats.groupBy("run", "tool_use_id").agg(F.max(top).alias("top")).select(
        "run", "tool_use_id", "top.tool", "top.seconds"
    )


def slow_calls_by_tool(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run", "tool").agg(
        F.count("*").alias("slow_tool_calls"), F.round(F.sum("seconds"), 1).alias("slow_tool_seconds"),
        F.count_if(F.col("seconds") >= TOOL_TIMEOUT_SECONDS).alias("timed_out_tool_calls"),
    )


def tool_timings(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: slow calls, their seconds, seconds per tool as a map, and calls that were killed.

    Every run of ``runs`` has a row; one without a heartbeat has zeros and an empty map.
    """
    per_tool = calls.groupBy("run", "tool").agg(
        F.count("*").alias("n"), F.sum("seconds").alias("s"),
        F.count_if(F.col("seconds") >= TOOL_TIMEOUT_SECONDS).alias("killed"),
    )
    timed = per_tool.groupBy("run").agg(
        F.sum("n").alias("slow_tool_calls"),
        F.round(F.sum("s"), 1).alias("slow_tool_seconds"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", F.round("s", 1))))).alias(
            "slow_tool_seconds_by_tool"
        ),
        F.sum("killed").alias("timed_out_tool_calls"),
    )
    none = F.create_map().cast("map<string,double>")
    return runs.select("run").distinct().join(timed, "run", "left").select(
        "run", F.coalesce("slow_tool_calls", F.lit(0)).alias("slow_tool_calls"),
        F.coalesce("slow_tool_seconds", F.lit(0.0)).alias("slow_tool_seconds"),
        F.coalesce("slow_tool_seconds_by_tool", none).alias("slow_tool_seconds_by_tool"),
        F.coalesce("timed_out_tool_calls", F.lit(0)).alias("timed_out_tool_calls"),
    )


def last_seen(records: DataFrame, value: str) -> DataFrame:
    """Last non-empty value per run in arrival order, null where a run has none; arrival is unique within a run."""
    kept = F.when(F.coalesce(F.col(value), F.lit("")) != "", F.struct("arrival", value))
    return records.groupBy("run").agg(F.max(kept).alias("last")).select("run", f"last.{value}")


def progress(records: DataFrame) -> DataFrame:
    """Turns so far and the most recent tool call per run."""
    turns = F.col("type") == "assistant"
    blocks = records.filter(turns).select(
        "run", "arrival", F.posexplode(F.coalesce("message.content", F.array())).alias("place", "block")
    ).filter(F.col("block.type") == "tool_use")
    last = blocks.groupBy("run").agg(
        F.max(F.struct("arrival", "place", F.coalesce("block.name", F.lit("-")).alias("tool"))).alias("last")
    ).select("run", F.col("last.tool").alias("last_tool"))
    return records.groupBy("run").agg(F.count_if(turns).alias("turns")).join(last, "run", "left").select(
        "run", "turns", F.coalesce("last_tool", F.lit("-")).alias("last_tool")
    )


def credential_rejected(records: DataFrame) -> DataFrame:
    """Runs and whether a 401 retry appears anywhere in them."""
    hit = (F.col("subtype") == "api_retry") & (F.col("error_status") == 401)
    return records.groupBy("run").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("credential_rejected"))


def tool_subject(payload: Column) -> Column:
    """What a call is about: the first filled subject key, on one line, long paths shortened."""

    def line(key: str) -> Column:
        text = F.trim(F.regexp_replace(F.try_element_at(payload, F.lit(key)), r"\s+", " "))
        if key in ("file_path", "path"):
            slashes = F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))
            text = F.when(slashes > 2, F.concat(F.lit(".../"), F.substring_index(text, "/", -2))).otherwise(text)
        return F.nullif(text, F.lit(""))

    return F.coalesce(*[line(k) for k in SUBJECT_KEYS], F.to_json(payload))


def call_pairs(records: DataFrame) -> DataFrame:
    """Each tool call beside its result: duration, and whether it failed. Open calls keep nulls.

    ``records`` carry ts. Calls and results meet on their id, so nothing is ordered globally.
    """
    blocks = records.select("run", "ts", F.explode("message.content").alias("b"))
    calls = blocks.filter(F.col("b.type") == "tool_use").select(
        "run", F.col("b.id").alias("tool_use_id"), F.coalesce("b.name", F.lit("?")).alias("tool"),
        F.col("ts").alias("started"),
    )
    results = blocks.filter(F.col("b.type") == "tool_result").select(
        "run", F.col("b.tool_use_id").alias("tool_use_id"), F.col("ts").alias("ended"),
        F.coalesce("b.is_error", F.lit(False)).alias("failed"),
    )
    seconds = F.col("ended").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double")
    return calls.join(results, ["run", "tool_use_id"], "left").withColumn("seconds", F.round(seconds, 1))


def heartbeats(beats: DataFrame) -> DataFrame:
    """Elapsed marks that would be shown: one once 60 seconds passed since the last one shown.

    A call started by another one beats under its parent's id. Marks are folded per call in order
    of arrival. A call beats every few seconds for at most its time limit, so its list of marks is
    short by nature; equal marks are dropped first.
    """
    if "parent_tool_use_id" in beats.columns:
        beats = beats.withColumn("tool_use_id", F.coalesce("parent_tool_use_id", "tool_use_id"))
    marks = beats.groupBy("run", "tool_use_id", "seconds").agg(F.min("arrival").alias("arrival"))
    per_call = marks.groupBy("run", "tool_use_id").agg(
        F.array_sort(F.collect_list(F.struct("arrival", "seconds"))).alias("marks")
    )
    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("shown"))

    def fold(acc: Column, mark: Column) -> Column:
        due = mark["seconds"] - acc["last"] >= HEARTBEAT_SECONDS
        return F.struct(
            F.when(due, mark["seconds"]).otherwise(acc["last"]).alias("last"),
            F.when(due, F.array_append(acc["shown"], mark["seconds"])).otherwise(acc["shown"]).alias("shown"),
        )

    folded = F.aggregate("marks", start, fold)["shown"]
    return per_call.select("run", "tool_use_id", F.explode(folded).alias("shown_at"))


def truncation_stats(readings: DataFrame, by: list[str], digits: int = 2) -> DataFrame:
    """Where incomplete responses stop, by bytes and by seconds; complete and failed ones do not count."""
    cut = readings.filter(~F.col("complete") & F.col("error").isNull())
    stats = cut.groupBy(*by).agg(
        F.count("*").alias("truncated"),
        (F.max("bytes") - F.min("bytes")).alias("bytes_spread"),
        F.round(F.max("total") - F.min("total"), digits).alias("seconds_spread"),
    )
    for measure in ("bytes", "total"):
        median = exact_median(cut, by, measure, f"_{measure}").withColumnsRenamed({k: f"_by_{k}" for k in by})
        same = F.lit(True)
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
        stats = stats.join(median, same, "left").drop(*[f"_by_{k}" for k in by])
    return stats.select(
        *by, "truncated", F.floor("_bytes").alias("bytes_median"), "bytes_spread",
        F.round("_total", digits).alias("seconds_median"), "seconds_spread",
    )


def run_id(started: Column, commit: Column) -> Column:
    """Sortable run name: UTC start time and a commit prefix."""
    stamp = F.date_format(started, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(stamp, F.lit("-"), F.substring(commit, 1, 7))
