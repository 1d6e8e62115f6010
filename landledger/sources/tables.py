"""Reading and writing the flat tables and their geometry column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger.functions import geometry as G
from landledger.functions.wkb import from_wkb, to_wkb
from landledger.sources.files import file_digests


def read_shapes(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """GeoParquet: the geometry column arrives as well-known binary and leaves decoded.

    Longitude comes first in every file; coordinate labels are not converted, as the two
    datums in use differ by less than a metre.
    """
    raw = spark.read.parquet(path)
    kept = raw.select(*columns, "geometry") if columns else raw
    return kept.withColumn("geometry", from_wkb("geometry"))


def read_parcels(spark: SparkSession, path: str) -> DataFrame:
    """Parcels with their shape columns and a row key, since ids repeat."""
    raw = spark.read.parquet(path).select(
        "*", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("row_key")
    )
    return G.with_shape(raw.withColumn("geometry", from_wkb("geometry")))


def write_shapes(df: DataFrame, path: str) -> None:
    df.withColumn("geometry", to_wkb(F.col("geometry"))).write.mode("overwrite").parquet(path)


def index_shapes(df: DataFrame, path: str, cell: float) -> None:
    """Write shapes sorted by cell with their bounds as columns, so readers can skip row groups."""
    placed = df.withColumns(G.bounds(F.col("geometry"))).withColumns(
        {"cell_x": F.floor(F.col("xmin") / cell), "cell_y": F.floor(F.col("ymin") / cell)}
    )
    write_shapes(placed.repartitionByRange("cell_x", "cell_y").sortWithinPartitions("cell_x", "cell_y"), path)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Persist a stage as Parquet and read it back, so later stages do not recompute it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_answer_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Header, newline ends, empty for null, booleans as True and False."""
    typed = dict(df.dtypes)
    shown = [
        F.initcap(F.col(c).cast("string")).alias(c) if typed[c] == "boolean" else F.col(c) for c in columns
    ]
    df.select(*shown).write.mode("overwrite").option("lineSep", "\n").option("emptyValue", "").csv(path, header=True)


def checksum_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the files under a folder, read in parts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return file_digests(files).select(F.substring_index("path", "/", -1).alias("name"), "sha256").orderBy("name")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
