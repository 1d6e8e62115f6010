"""Run folders: transcripts, metadata and answer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger.sources.files import read_csv_rows

BLOCK = (
    "struct<type:string,id:string,name:string,input:map<string,string>,tool_use_id:string,"
    "is_error:boolean,content:string>"
)
RECORD_SCHEMA = (
    "type string, subtype string, session_id string, ts timestamp, "
    "usage struct<input_tokens:bigint,output_tokens:bigint,"
    "cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>, "
    "tool_use_id string, parent_tool_use_id string, tool_name string, elapsed_time_seconds double, "
    f"error_status int, message struct<content:array<{BLOCK}>>"
)
META_SCHEMA = (
    "model string, model_id string, run_id string, label string, started_utc string, finished_utc string, "
    "duration_seconds double, exit_code int, attempts int, harness_commit string, input_mode string, "
    "golden_fingerprint string, graded_against string, spec_fingerprint string, "
    "spec_manifest map<string,string>, "
    "ablation struct<arm:string,why:string>, turns bigint, input_tokens bigint, output_tokens bigint, "
    "cache_creation_tokens bigint, cache_read_tokens bigint, slow_tool_calls int, slow_tool_seconds double, "
    "slow_tool_seconds_by_tool map<string,double>, timed_out_tool_calls int, imputed_cost_usd double, "
    "answers_written int, status string"
)


def _run_name(up: int) -> Column:
    """``model/run`` from the file path, ``up`` folders above the file."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.concat_ws("/", F.element_at(parts, -up - 2), F.element_at(parts, -up - 1))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``<path>/<model>/<run>/transcript.jsonl``; a broken last line is dropped."""
    raw = spark.read.schema(RECORD_SCHEMA).option("mode", "DROPMALFORMED").json(f"{path}/*/*/transcript.jsonl")
    # Position within the file: byte offset of the block, then order within the task.
    arrival = F.col("_metadata.file_block_start") + F.monotonically_increasing_id()
    return raw.select(_run_name(1).alias("run"), arrival.alias("arrival"), "*")


def read_meta(spark: SparkSession, path: str, model: str = "*") -> DataFrame:
    """One row per run folder holding a meta.json, the arm lifted out of its block."""
    raw = spark.read.schema(META_SCHEMA).option("multiLine", "true").json(f"{path}/{model}/*/meta.json")
    return raw.select(
        _run_name(1).alias("run"), F.split_part(_run_name(1), F.lit("/"), F.lit(1)).alias("model_dir"), "*",
        F.col("ablation.arm").alias("arm"),
    ).orderBy("run")


def read_answers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Body rows (run, qid, row_no, cells) and the written files (run, qid)."""
    return _tables(spark, f"{path}/*/*/answers/q*.csv", 2, ["run", "qid"])


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Body rows (qid, row_no, cells) and (qid, header)."""
    return _tables(spark, f"{path}/q*.csv", None, ["qid"])


def _tables(spark: SparkSession, pattern: str, up: int | None, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    lines = read_csv_rows(spark, pattern)
    heads = lines.filter("place = 0")  # a file's first row that is not empty
    qid = F.regexp_extract("file_path", r"([^/]+)\.csv$", 1).alias("qid")
    parts = F.split("file_path", "/")
    names = [qid]
    if up is not None:
        names = [F.concat_ws("/", F.element_at(parts, -up - 2), F.element_at(parts, -up - 1)).alias("run"), qid]
    rows = lines.filter("place > 0").select(*names, F.col("place").alias("row_no"), "cells")
    headers = heads.select(*names, F.transform("cells", F.trim).alias("header"))
    return rows, headers


def read_artifacts(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, arrival, cod_imovel, loss, contact) from workflow tables, cells by header name."""
    raw = spark.read.csv(pattern, header=True, inferSchema=False, enforceSchema=False)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(
        F.concat_ws("/", F.element_at(parts, -4), F.element_at(parts, -3)).alias("run"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("arrival"),
        "cod_imovel", F.col("post2020_loss_ha").alias("loss"), F.col("top_contact_entity_id").alias("contact"),
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, stage, depends_on, geometry) from a JSON-lines spec."""
    schema = "id string, stage int, depends_on array<string>, grading string"
    raw = spark.read.schema(schema).json(path)
    return raw.select(
        F.concat(F.lit("q"), "id").alias("qid"), "stage",
        F.transform(F.coalesce("depends_on", F.array().cast("array<string>")), lambda d: F.concat(F.lit("q"), d))
        .alias("depends_on"),
        (F.coalesce("grading", F.lit("")) == "geometry").alias("geometry"),
    )
