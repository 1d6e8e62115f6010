"""Growing text files as a streaming source: `spark.readStream.format("growing_lines").load(pattern)`.

The offset of the stream is the length of each file as it was last seen, kept by Spark in the query's own checkpoint, so a
restarted query goes on where it stopped, without loss or repeats. A batch is the bytes between two offsets, cut into
ranges of at most `split_bytes`, small ones put together for a task. A range yields the lines whose line break lies in it, looking
back for where the first one began; a half-written last line therefore comes with the batch that brings its end, and no
range depends on another. Files are expected to grow only; a file that became shorter is followed from its new end. A
batch's ranges follow from the two offsets, so a repeated batch reads the same lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from landledger.sources.runs import RECORD_SCHEMA

SPLIT_BYTES = 32 << 20
#: A range counts as so many bytes at least when small ones are put together for a task.
OPEN_COST = 1 << 20
#: Bytes read at a time, and lines handed on at a time.
CHUNK, LINES = 1 << 20, 4096
_LINE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())])


class Ranges(InputPartition):
    """(path, start, stop) of ranges that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def _line_start(file: pa.NativeFile, at: int) -> int:
    """Where the line that holds the byte before `at` began."""
    while at > 0:
        back = max(0, at - (1 << 16))
        file.seek(back)
        found = file.read(at - back).rfind(b"\n")
        if found >= 0:
            return back + found + 1
        at = back
    return 0


def lines_of(path: str, start: int, stop: int, chunk: int = CHUNK) -> Iterator[tuple[int, int, bytes]]:
    """(first byte, byte after the line break, line) of the lines that end in the bytes from start to stop."""
    system, place = pafs.FileSystem.from_uri(path)
    with system.open_input_file(place) as file:
        begin = _line_start(file, start)
        file.seek(begin)
        head = file.read(start - begin)  # of the line that goes on into the range; a line break before `start` ends the one before
        at, rest, position = begin, head, start
        while position < stop:
            read = file.read(min(chunk, stop - position))
            if not read:
                return
            position += len(read)
            *full, rest = (rest + read).split(b"\n")
            for line in full:
                yield at, at + len(line) + 1, line
                at += len(line) + 1


class GrowingReader(DataSourceStreamReader):
    def __init__(self, pattern: str, split_bytes: int):
        pattern = re.sub(r"^(\w+):/(?!/)", r"\1:///", pattern) if re.match(r"\w+:/", pattern) else f"file://{pattern}"
        self.split_bytes = split_bytes
        self.system, place = pafs.FileSystem.from_uri(pattern)
        self.before = pattern[: pattern.index(place)]  # scheme and host
        parts = place.split("/")
        fixed = next((k for k, p in enumerate(parts) if "*" in p), len(parts) - 1)
        self.root = "/".join(parts[:fixed])
        self.match = re.compile("/".join(re.escape(p).replace(r"\*", "[^/]*") for p in parts))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        listed = self.system.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return {x.path: x.size for x in sorted(listed, key=lambda x: x.path) if x.is_file and self.match.fullmatch(x.path)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        tasks, room = [], 0
        for path, size in end.items():
            for at in range(start.get(path, 0), size, self.split_bytes):
                stop = min(at + self.split_bytes, size)
                cost = max(stop - at, OPEN_COST)
                if not tasks or cost > room:
                    tasks.append(Ranges([]))
                    room = self.split_bytes
                tasks[-1].ranges.append((self.before + path, at, stop))
                room -= cost
        return tasks

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _LINE, strict=True)], schema=_LINE)

        for path, first, last in partition.ranges:
            for start, stop, line in lines_of(path, first, last):
                rows.append((path, start, stop, line.decode("utf-8", "replace")))
                if len(rows) == LINES:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


class GrowingLines(DataSource):
    """Lines of all files that match a path with `*` for any part of a name: file, start, stop (bytes) and value."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, start bigint, stop bigint, value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def growing_lines(spark: SparkSession, pattern: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("split_bytes", split_bytes).load(pattern)


def follow_transcripts(spark: SparkSession, source: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of `<source>/<model>/<run>/transcript.jsonl` as they are written; `arrival` is the place in the file.

    Lines that are no record are left out, as are those without a type.
    """
    lines = growing_lines(spark, f"{source}/*/*/transcript.jsonl", split_bytes)
    parts = F.split("file", "/")
    run = F.concat_ws("/", F.element_at(parts, -3), F.element_at(parts, -2))
    parsed = lines.select(run.alias("run"), F.col("start").alias("arrival"), F.from_json("value", RECORD_SCHEMA).alias("r"))
    return parsed.where(F.col("r.type").isNotNull()).select("run", "arrival", "r.*")
