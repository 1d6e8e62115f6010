"""The shared folder, written stages and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A slice of a batch holds at most so many text bytes, or one row.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a private one on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application's operators wrote to the shared folder; their results cannot be read afterwards."""
    delete(spark, _own_folder(spark))


def staged(df: DataFrame, name: str, instead_of: str | None = None) -> tuple[DataFrame, str]:
    """df as a written table, and its folder: computed once, and safe when an executor is lost.

    `instead_of` is the folder of a table that df was made from and that nothing else reads; it is deleted.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    if instead_of:
        delete(spark, instead_of)
    return spark.read.schema(df.schema).parquet(folder), folder


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and where each row starts (one more entry than rows); null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    pa.default_memory_pool().release_unused()  # the worker lives on for other tasks


def fresh(taken: list[str], name: str) -> str:
    """`name`, or with underscores until no column has it."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def sample_texts(df: DataFrame, text: str, rows: int) -> list[str]:
    """Up to `rows` different texts, those of certain hashes; only about that many leave the executors."""
    df = df.where(F.col(text).isNotNull())
    different = df.agg(F.approx_count_distinct(text)).first()[0]  # copies of a text are one
    step = max(1, different // rows)
    mark = F.pmod(F.xxhash64(text), F.lit(step)) == 0
    return [r[0] for r in df.where(mark).select(text).distinct().orderBy(F.xxhash64(text), text).limit(rows).collect()]
