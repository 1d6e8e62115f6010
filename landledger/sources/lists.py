"""The encodings of the input list, read to one schema: row_id, raw_id, raw_wkt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger.functions import geometry as G
from landledger.functions.wkb import from_wkb


def arrival() -> Column:
    """Sorts as the rows arrived: file, block within the file, position within the task."""
    return F.concat_ws(
        ":",
        "_metadata.file_path",
        F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"),
        F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"),
    )


def read_csv_list(spark: SparkSession, path: str, id_column: str = "cod_imovel") -> DataFrame:
    """All cells are text and may hold line breaks; a list without an id or geometry column reads as nulls there."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    have = set(raw.columns)

    def cell(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    return raw.select(arrival().alias("row_id"), cell(id_column).alias("raw_id"), cell("geometry").alias("raw_wkt"))


def read_geometry_list(spark: SparkSession, path: str, id_column: str = "cod_imovel") -> DataFrame:
    """A shape that has no text form here keeps its bytes as text, so that different ones stay different."""
    raw = spark.read.parquet(path)
    ids = F.col(id_column) if id_column in raw.columns else F.lit(None).cast("string")
    rows = raw.select(arrival().alias("row_id"), ids.alias("raw_id"), from_wkb("geometry").alias("shape"), "geometry")
    return rows.select("row_id", "raw_id", F.coalesce(G.to_wkt(F.col("shape")), F.hex("geometry")).alias("raw_wkt"))


_FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
_POSITION = r"\[\s*([-+0-9.eE]+)\s*,\s*([-+0-9.eE]+)\s*(?:,[^\[\]]*)?\]"


def read_geojson_list(spark: SparkSession, path: str, id_column: str = "cod_imovel", lines: bool = False) -> DataFrame:
    """Features of collections, or one feature a line. Coordinates past the second are dropped."""
    schema = f"features array<{_FEATURE}>, properties map<string,string>, geometry struct<type:string,coordinates:string>"
    raw = spark.read.schema(schema).json(path, multiLine=not lines)
    alone = F.array(F.struct("properties", "geometry"))
    features = raw.select(arrival().alias("_file"), F.posexplode(F.coalesce("features", alone)).alias("_at", "f"))
    pairs = F.regexp_replace("f.geometry.coordinates", _POSITION, "$1 $2")
    kind, body = F.upper("f.geometry.type"), F.translate(pairs, "[]", "()")
    wkt = F.when(kind == "POINT", F.concat(F.lit("POINT ("), body, F.lit(")"))).otherwise(F.concat(kind, F.lit(" "), body))
    row_id = F.concat_ws(":", "_file", F.lpad(F.col("_at").cast("string"), 10, "0"))
    return features.select(row_id.alias("row_id"), F.try_element_at("f.properties", F.lit(id_column)).alias("raw_id"), wkt.alias("raw_wkt"))


def read_split_list(spark: SparkSession, csv_path: str, shape_path: str, id_column: str = "cod_imovel") -> DataFrame:
    """Ids from the CSV, shapes from the second file where the CSV has none. Each shape of an id is a row of its own."""
    listed = read_csv_list(spark, csv_path, id_column)
    shapes = read_geometry_list(spark, shape_path, id_column).select(
        F.trim("raw_id").alias("_id"), F.col("raw_wkt").alias("_wkt"), F.col("row_id").alias("_shape")
    )
    own = F.nullif(F.trim("raw_wkt"), F.lit(""))
    joined = listed.join(shapes, (F.trim("raw_id") == F.col("_id")) & own.isNull(), "left")
    return joined.select(F.concat_ws("/", "row_id", "_shape").alias("row_id"), "raw_id", F.coalesce(own, "_wkt").alias("raw_wkt"))


def read_list(spark: SparkSession, mode: str, path: str, shape_path: str | None = None) -> DataFrame:
    if mode == "csv":
        return read_csv_list(spark, path)
    if mode == "geometry":
        return read_geometry_list(spark, path)
    if mode in ("geojson", "geojsonl"):
        return read_geojson_list(spark, path, lines=mode == "geojsonl")
    if mode == "split":
        return read_split_list(spark, path, shape_path)
    raise ValueError(f"unknown list encoding {mode!r}")
