"""Small documents with every awkward row, and plain versions of the contracts to compare with."""

from __future__ import annotations

import re
import zlib

import pyarrow.parquet as pq
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("n_words", T.StringType()), T.StructField("near_row", T.StringType()), T.StructField("held", T.StringType())])


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return ALNUM.findall(lower(text or ""))


def real(n: int = 60) -> list[tuple]:
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()[:n]
    return [(r["doc_id"], r["text"], r["lang"], "x", "y", "z") for r in rows]


def awkward() -> list[tuple]:
    body = real(3)[2][1]
    long = " ".join(f"w{k % 977}x{k}" for k in range(40_000))
    extra = [(9001, None, None), (9002, "", "en"), (9003, " \n\t ", "en"), (9004, body, "en"), (9004, body, "en"), (9005, body + " tail", None),
             (9006, long, "en"), (9007, "..!! ,, 12", "de"), (None, "a row without id " * 20, "fr"), (9008, "日本語 テスト \U0001f600 a b\x1cc", "ja"),
             (9009, "mail me.x@a.example.org now, or 10.0.0.256 and 10.0.0.25, card 4111 1111 1111 1111, call +1 (555) 555-0199", "en"),
             (9010, "released under\nthe MIT license. Apache, License: version 2; CC-BY-NC", "en")]
    return [(*r, None, "y", "z") for r in extra]


def documents(spark, rows: list[tuple] | None = None):
    rows = [*real(), *awkward()] if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(doc_id, n: int, held: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == held
