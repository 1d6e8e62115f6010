"""Files read and written from start to end inside a task, where Spark's readers and writers cannot split, parse or name them."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger.session import kernel_partitions

CSV_ROWS = "file_path string, place bigint, cells array<string>"
#: Rows handed on at a time.
CHUNK_ROWS = 4096
#: Bytes of a file in memory at a time.
CHUNK_BYTES = 1 << 20


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the place in it, by the path Spark gives; ``file:/x`` is ``file:///x``."""
    return pafs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path))


def open_file(path: str) -> pa.NativeFile:
    system, place = locate(path)
    return system.open_input_file(place)


def _csv_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 31)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open_file(path) as file:
                rows, place = [], 0
                for cells in csv.reader(io.TextIOWrapper(file, "utf-8-sig", "replace", newline="")):
                    if cells:
                        rows.append((path, place, cells))
                        place += 1
                    if len(rows) == CHUNK_ROWS:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["file_path", "place", "cells"])


def read_csv_rows(spark: SparkSession, pattern: str) -> DataFrame:
    """(file_path, place, cells) of every CSV file of any width; quoted cells may hold commas, quotes and line breaks.

    A file is read by one task, a few rows at a time. Names are dealt over the shuffle's partitions, since Spark would start
    a task for each few dozen files, however small they are.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path").repartition(kernel_partitions(spark))
    return files.mapInArrow(_csv_rows, CSV_ROWS)


def csv_line(cells: Column) -> Column:
    """Cells as a line of CSV, quoted where they hold a comma, a quote or a line break; null is empty."""

    def quoted(cell: Column) -> Column:
        text = F.coalesce(cell, F.lit(""))
        return F.when(text.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.array_join(F.transform(cells, quoted), ",")


def _write_lines(batches: Iterator[pa.RecordBatch], head: str = "", between: str = "\n", tail: str = "\n") -> Iterator[pa.RecordBatch]:
    path, lines, out, unnamed = None, 0, None, ""
    done: list[tuple[str, int]] = []

    def close() -> None:
        if path is not None:
            out.write(tail.encode())
            out.close()
            system, place = locate(path)
            system.move(locate(unnamed)[1], place)
            done.append((path, lines))

    for batch in batches:
        for at, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if at != path:
                close()
                folder, _, name = at.rpartition("/")
                path, lines, unnamed = at, 0, f"{folder}/.{name}.{uuid.uuid4().hex}"
                system, place = locate(unnamed)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place)
            out.write(((between if lines else head) + line).encode())
            lines += 1
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "n_lines": [d[1] for d in done]})
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "n_lines": [d[1] for d in done]})


def write_lines(rows: DataFrame) -> int:
    """Write (path, place, line) as one text file per path, its lines in order of place; the number of files.

    Lines are streamed to a file of another name, hidden from readers, which is renamed when it is whole, so a repeated
    task leaves whole files. Files are written by as many tasks as there are partitions.
    """
    ordered = rows.select("path", "place", "line").repartition("path").sortWithinPartitions("path", "place")
    return ordered.mapInArrow(_write_lines, "path string, n_lines bigint").count()


def write_collections(rows: DataFrame, feature: Column, folder: str, most: int) -> int:
    """Write features as JSON files of one collection each, with at most ``most`` features; the number of files.

    A task streams the rows it has into files of its own, so no collection is ever in memory. What was in the folder is
    deleted first.
    """
    system, place = locate(folder)
    system.create_dir(place, recursive=True)
    system.delete_dir_contents(place)
    numbered = rows.select(F.monotonically_increasing_id().alias("at"), F.to_json(feature).alias("line"))
    # the id's upper bits are the partition, the lower 33 the row's place in it
    part, lot = F.shiftright("at", 33), F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / most)
    named = numbered.select(F.concat(F.lit(f"{folder}/"), part.cast("string"), F.lit("-"), lot.cast("string"), F.lit(".json")).alias("path"), "line")
    return named.mapInArrow(lambda batches: _write_lines(batches, '{"features":[', ",\n", "]}\n"), "path string, n_lines bigint").count()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"path": batch.column("path").to_pylist(), "size": [], "sha256": []}
        for path in out["path"]:
            chain, size = hashlib.sha256(), 0
            with open_file(path) as file:
                while chunk := file.read(CHUNK_BYTES):
                    chain.update(chunk)
                    size += len(chunk)
            out["size"].append(size)
            out["sha256"].append(chain.hexdigest())
        yield pa.RecordBatch.from_pydict(out)


def file_digests(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files by path, of any size: a task holds a part of one file at a time."""
    return files.select("path").mapInArrow(_digest, "path string, size bigint, sha256 string")
