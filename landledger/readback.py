"""Queries over files that are written from the given tables and read again the way a user would."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger import derive as D
from landledger.functions import geometry as G
from landledger.functions.projection import spheroid_area_m2
from landledger.functions.wkb import to_wkb
from landledger.operators import grading as Q
from landledger.operators import rollups as V
from landledger.operators import usage as U
from landledger.plans.stages import Stages
from landledger.sources import runs, tables
from landledger.sources.files import csv_line, write_collections, write_lines
from landledger.sources.lists import read_list
from landledger.streaming import tail, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{Stages.of(spark, sf_dir).root}/{name}"


#: Rows of a file that one task reads from start to end; more rows are more files.
LIST_ROWS = 20_000


@query
def list_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines as a list in five encodings, each read back to ids and shapes."""
    root = _folder(spark, sf_dir, f"lists-{LIST_ROWS}")
    part = {"maxRecordsPerFile": LIST_ROWS}
    ids = F.concat(F.lit("P"), F.col("row_key").cast("string"))
    listed = Stages.of(spark, sf_dir).table("listed-outlines", lambda: D.outlines(spark, sf_dir).select(ids.alias("cod_imovel"), "row_key", "geometry"))
    wkt, even = G.to_wkt(F.col("geometry")), F.col("row_key") % 2 == 0
    listed.select("cod_imovel", wkt.alias("geometry")).write.mode("overwrite").options(**part).csv(f"{root}/csv", header=True)
    listed.select("cod_imovel", to_wkb(F.col("geometry")).alias("geometry")).write.mode("overwrite").parquet(f"{root}/geometry")
    listed.select("cod_imovel", F.when(~even, wkt).alias("geometry")).write.mode("overwrite").options(**part).csv(f"{root}/split", header=True)
    listed.where(even).select("cod_imovel", to_wkb(F.col("geometry")).alias("geometry")).write.mode("overwrite").parquet(f"{root}/shapes")
    rings = F.transform("geometry.rings", lambda r: F.transform(r["pts"], lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("cod_imovel").alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"))
    listed.select(feature.alias("f")).select("f.*").write.mode("overwrite").json(f"{root}/geojsonl")
    write_collections(listed, feature, f"{root}/geojson", LIST_ROWS)
    read = None
    for mode in ("csv", "geometry", "split", "geojsonl", "geojson"):
        rows = read_list(spark, mode, f"{root}/{mode}", f"{root}/shapes").withColumn("mode", F.lit(mode))
        read = rows if read is None else read.unionByName(rows)
    shaped = G.with_shape(read.withColumn("geometry", G.from_wkt(F.col("raw_wkt"))))
    form = F.substring("raw_id", 2, 20).cast("bigint") % 3
    return shaped.groupBy("mode", form.alias("form"), "geometry.kind").agg(
        F.count("*").alias("n_rows"), F.count_distinct("raw_id").alias("n_ids"), F.round(F.sum("area"), 3).alias("area"))


HEADER = ["part", "type", "price"]


def _answer_files(rows: DataFrame, path, header: list[str]) -> DataFrame:
    heads = rows.select(path.alias("path")).distinct().select("path", F.lit(-1).alias("place"), csv_line(F.array(*[F.lit(h) for h in header])).alias("line"))
    return rows.select(path.alias("path"), F.col("row_no").alias("place"), csv_line(F.col("cells")).alias("line")).unionByName(heads)


@query
def answer_tables_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as one CSV file each and read back: rows, widths and what the cells hold."""
    root = _folder(spark, sf_dir, "answers")
    path = F.concat(F.lit(f"{root}/m/"), "run", F.lit("/answers/"), "qid", F.lit(".csv"))
    write_lines(_answer_files(D.answer_tables(spark, sf_dir), path, HEADER))
    rows, _ = runs.read_answers(spark, root)
    keys = F.aggregate(F.filter("cells", lambda c: c.rlike("^[0-9]+$")), F.lit(0).cast("bigint"), lambda a, c: a + c.cast("bigint"))
    letters = F.aggregate(F.filter("cells", lambda c: c.rlike("[A-Za-z]")), F.lit(0), lambda a, c: a + F.length(c))
    return rows.groupBy("run", "qid").agg(
        F.count("*").alias("n_rows"), F.min(F.size("cells")).alias("narrowest"), F.max(F.size("cells")).alias("widest"), F.sum(keys).alias("keys"), F.sum(letters).alias("letters"))


@query
def golden_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden tables written as CSV files, and the files' digests."""
    root = _folder(spark, sf_dir, "golden")
    write_lines(_answer_files(D.golden_tables(spark, sf_dir), F.concat(F.lit(f"{root}/"), "qid", F.lit(".csv")), HEADER))
    return tables.checksum_manifest(spark, root)


@query
def answer_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through the answer sink: nulls empty, booleans as words, read back as text."""
    root = _folder(spark, sf_dir, "answer-csv")
    k = F.col("p_partkey")
    shown = D.table(spark, sf_dir, "part").select(k.alias("part"), (k % 3 == 0).alias("flag"), F.when(k % 4 > 0, F.col("p_type")).alias("type"))
    tables.write_answer_csv(shown, root, ["part", "flag", "type"])
    read = spark.read.option("emptyValue", "(empty)").csv(root, header=True, schema="part string, flag string, type string")
    return read.select("part", "flag", F.coalesce("type", F.lit("-")).alias("type"))


@query
def run_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written as one file a run and read back by folder."""
    root = _folder(spark, sf_dir, "runs")
    meta = D.run_meta(spark, sf_dir)
    told = F.struct(
        "model", F.col("run").cast("string").alias("run_id"), "status", "duration_seconds", F.col("turns").cast("bigint").alias("turns"),
        F.struct("arm", F.lit("a reason").alias("why")).alias("ablation"), F.create_map(F.lit("Bash"), F.col("slow_tool_seconds")).alias("slow_tool_seconds_by_tool"))
    path = F.concat(F.lit(f"{root}/"), "model", F.lit("/"), F.col("run").cast("string"), F.lit("/meta.json"))
    write_lines(meta.select(path.alias("path"), F.lit(0).alias("place"), F.to_json(told).alias("line")))
    read = runs.read_meta(spark, root)
    return read.select("run", "model_dir", "run_id", F.coalesce("arm", F.lit("full")).alias("arm"), F.coalesce("status", F.lit("-")).alias("status"), "turns",
                       F.round(F.col("duration_seconds") - 4 * F.element_at("slow_tool_seconds_by_tool", "Bash"), 6).alias("rest"))


def _transcripts(spark: SparkSession, sf_dir: str) -> str:
    """Transcripts of events, one file a run."""
    root = _folder(spark, sf_dir, "transcripts")

    def build() -> DataFrame:
        records = D.transcript(spark, sf_dir)
        path = F.concat(F.lit(f"{root}/m/"), F.col("run").cast("string"), F.lit("/transcript.jsonl"))
        line = F.to_json(F.struct(*[c for c in records.columns if c not in ("run", "arrival")]))
        files = write_lines(records.select(path.alias("path"), F.col("arrival").alias("place"), line.alias("line")))
        return spark.range(1).select(F.lit(files).alias("files"))

    Stages.of(spark, sf_dir).table("transcripts-written", build)
    return root


@query
def transcripts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and tokens from transcript files."""
    return U.usage_totals(runs.read_transcripts(spark, _transcripts(spark, sf_dir)))


def _streamed(spark: SparkSession, df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream over the files there are has to tell, as a table."""
    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    told = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-checkpoint").foreachBatch(keep)
    told.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(folder)


@query
def transcripts_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the files as a stream."""
    records = tail.follow_transcripts(spark, _transcripts(spark, sf_dir))
    kept = Stages.of(spark, sf_dir).table("followed", lambda: _streamed(spark, records, _folder(spark, sf_dir, "followed-stream")))
    return U.usage_totals(kept)


def _watched(spark: SparkSession, records: DataFrame, folder: str) -> DataFrame:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, watch.STATE_STORE)
    try:
        return _streamed(spark, watch.watch_calls(records), folder, "update")
    finally:
        spark.conf.set(key, before)


@query
def beats_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulses of running calls, told by the stream that watches them."""
    records = tail.follow_transcripts(spark, _transcripts(spark, sf_dir))
    told = Stages.of(spark, sf_dir).table("watched-beats", lambda: _watched(spark, records, _folder(spark, sf_dir, "watched-beats-stream")))
    return told.where("event = 'beat'").select(F.substring_index("run", "/", -1).cast("bigint").alias("run"), F.col("call_id").alias("tool_use_id"), F.col("seconds").alias("shown_at"))


@query
def calls_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with and without results, told by the stream that watches them."""
    root = _folder(spark, sf_dir, "calls")

    def build() -> DataFrame:
        records = D.call_records(spark, sf_dir)
        path = F.concat(F.lit(f"{root}/m/"), (F.col("run") % 200).cast("string"), F.lit("/transcript.jsonl"))
        told = F.struct(F.lit("assistant").alias("type"), "ts", "message")
        write_lines(records.select(path.alias("path"), F.monotonically_increasing_id().alias("place"), F.to_json(told).alias("line")))
        return _watched(spark, tail.follow_transcripts(spark, root), _folder(spark, sf_dir, "watched-calls-stream"))

    told = Stages.of(spark, sf_dir).table("watched-calls", build)
    started = told.where("event = 'started'").select(F.col("call_id").alias("tool_use_id"), "tool")
    ended = told.where("event = 'ended'").select(F.col("call_id").alias("tool_use_id"), "failed", F.round("seconds", 1).alias("seconds"))
    return started.join(ended, "tool_use_id", "left")


@query
def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes per run through the JSON sink and back."""
    root = _folder(spark, sf_dir, "results-json")
    counts = Q.outcome_counts(D.grades(spark, sf_dir))
    tables.write_json(counts, root)
    return spark.read.schema(counts.schema).json(root)


@query
def catalog_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child collections among the links of catalogue documents, one for each nation."""
    root = _folder(spark, sf_dir, "catalogs")
    k = F.col("s_suppkey")
    rel = F.when(k % 3 == 0, "item").otherwise("child")
    href = F.concat(k.cast("string"), F.when(k % 5 == 0, "/catalog.json").otherwise("/collection.json"))
    links = D.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("id")).agg(F.collect_list(F.struct(rel.alias("rel"), href.alias("href"))).alias("links"))
    tables.write_json(links, root)
    return V.catalog_children(spark.read.schema("id string, links array<struct<rel:string,href:string>>").json(root))


@query
def geodesic_hectares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hectares of boxes of degrees on the ellipsoid."""
    k = F.col("c_custkey")
    west, south = k % 1000 / 100.0 - 60, -(k % 2300) / 100.0 - 1
    boxes = D.table(spark, sf_dir, "customer").select(k, G.box(west, south, west + (1 + k % 7) / 100.0, south + 0.02).alias("geometry"))
    return boxes.select("c_custkey", F.round(spheroid_area_m2(F.col("geometry")) / 10_000, 3).alias("hectares"))
