"""Text jobs over document tables: secrets, Markdown sections, digests.

Long texts are split into lines once; everything after that is a join or an aggregate
on (path, line number), so no document has to fit one Python call.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType
from pyspark.sql.window import Window

# Patterns of a credential, of its payload, and of paths never to be kept.
TOKEN = r"sk-ant-[A-Za-z0-9_-]{8,}"
PAYLOAD_KEYS = [r'"accessToken"\s*:', r'"refreshToken"\s*:']
BLOCKED_PATHS = r"(^|/)\.credentials\.json$|(^|/)\.claude/|(^|/)\.env($|\.)|\.pem$"

# Markdown heading and code fence.
HEADING = r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"
FENCE = r"^[ \t]*(```|~~~)"

# Line ends of text, and of raw bytes.
NEWLINE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BYTE_NEWLINE = r"\r\n|[\n\r]"
LAST_NEWLINE = rf"({NEWLINE})\z"


def text_lines(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_no from 1, line); a final newline does not open another line."""
    body = F.regexp_replace(F.col(text), LAST_NEWLINE, "")
    lines = docs.filter(F.length(text) > 0).select(
        F.col(path).alias("path"), F.posexplode(F.split(body, NEWLINE)).alias("_at", "line")
    )
    return lines.select("path", (F.col("_at") + 1).alias("line_no"), "line")


def _first_line(text: Column, pattern: str) -> Column:
    """Line number of the first match: newlines before it, plus one."""
    start = F.regexp_instr(text, F.lit(pattern))
    before = F.substring(text, F.lit(1), F.greatest(start - 1, F.lit(0)))
    return F.when(start > 0, F.regexp_count(before, F.lit(BYTE_NEWLINE)) + 1)


def secret_scan(docs: DataFrame, path: str = "path", text: str = "text", pattern: str = TOKEN) -> DataFrame:
    """(path, line_no, problem) of documents that must not be committed; a map over the table."""
    name, body = F.col(path), F.col(text)
    blocked = name.rlike(BLOCKED_PATHS)
    token = body.rlike(pattern)
    payload = body.rlike(PAYLOAD_KEYS[0]) & body.rlike(PAYLOAD_KEYS[1])
    problem = F.when(blocked, "blocked_path").when(token, "token").when(payload, "payload")
    return docs.select(name.alias("path"), F.when(~blocked & token, _first_line(body, pattern)).alias("line_no"),
                       problem.alias("problem")).filter(F.col("problem").isNotNull())


@F.pandas_udf(ArrayType(BooleanType()))
def _outside_fences(markers: pd.Series) -> pd.Series:
    """Per document, in line order: True where a marked line is neither a fence nor fenced."""

    def walk(tokens) -> list[bool]:
        opened, out = None, []
        for token in tokens:
            out.append(token is None and opened is None)
            if token is not None:
                opened = token if opened is None else None if token == opened else opened
        return out

    return markers.map(walk)


def section_index(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_no, level, title) of ATX headings outside fenced blocks.

    A line opens a fence when none is open and closes it when it starts with the open marker.
    Only fence and heading lines are gathered per document.
    """
    lines = text_lines(docs, path, text)
    marked = lines.select(
        "path", "line_no",
        F.nullif(F.regexp_extract("line", FENCE, 1), F.lit("")).alias("fence"),
        F.length(F.regexp_extract("line", HEADING, 1)).alias("level"),
        F.trim(F.regexp_extract("line", HEADING, 2)).alias("title"),
    ).filter(F.col("fence").isNotNull() | (F.col("level") > 0))
    entry = F.struct("line_no", "fence", "level", "title")
    per_doc = marked.groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    flagged = per_doc.withColumn("free", _outside_fences(F.transform("entries", lambda e: e["fence"])))
    both = F.explode(F.arrays_zip("entries", "free")).alias("z")
    return flagged.select("path", both).filter("z.free").select(
        "path", "z.entries.line_no", "z.entries.level", "z.entries.title"
    )


def section_ranges(headings: DataFrame) -> DataFrame:
    """Each heading with the line its section ends before; null means the end of the document.

    A section runs to the next heading of the same or a shallower level: for each of the six
    levels, the least later line of that level or above. The groups are single documents.
    """
    later = Window.partitionBy("path").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    end_line = F.lit(None).cast("int")
    for level in range(1, 7):
        following = F.min(F.when(F.col("level") <= level, F.col("line_no"))).over(later)
        end_line = F.when(F.col("level") == level, following).otherwise(end_line)
    return headings.withColumn("end_line", end_line)


def tidy(body: Column) -> Column:
    """At most one blank line in a row, none at the end, one final newline; null if nothing is left."""
    closed = F.regexp_replace(body, r"(?m)(^[^\S\n]*\n)(?:[^\S\n]*\n)+", "$1")
    trimmed = F.regexp_replace(closed, r"(\n[^\S\n]*)+\z", "")
    return F.when(~trimmed.rlike(r"\A\s*\z"), F.concat(trimmed, F.lit("\n")))


def cut_sections(docs: DataFrame, cuts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Remove one section per request (path, heading).

    Result: path, heading, text, lines_removed, error. A heading that is absent, repeated or
    would leave nothing behind is reported in the error column and cuts nothing.
    """
    ranges = section_ranges(section_index(docs, path, text)).withColumnRenamed("title", "heading")
    wanted = cuts.select("path", F.trim("heading").alias("heading"))
    hits = wanted.join(ranges, ["path", "heading"], "left").groupBy("path", "heading").agg(
        F.count("line_no").alias("n"), F.min("line_no").alias("start"), F.min("end_line").alias("end_line")
    )
    bodies = docs.select(F.col(path).alias("path"), F.col(text).alias("_text"))
    lines = F.split(F.regexp_replace("_text", LAST_NEWLINE, ""), NEWLINE)
    joined = hits.join(bodies, "path", "left").withColumn("_lines", lines).withColumn(
        "_stop", F.coalesce(F.col("end_line") - 1, F.size("_lines"))
    )
    kept = F.filter("_lines", lambda line, i: (i + 1 < F.col("start")) | (i + 1 > F.col("_stop")))
    cut = joined.withColumn("_kept", F.when(F.col("n") == 1, tidy(F.array_join(kept, "\n"))))
    error = (
        F.when(F.col("_text").isNull(), "no document")
        .when(F.col("n") == 0, "no heading")
        .when(F.col("n") > 1, "repeated heading")
        .when(F.col("_kept").isNull(), "would empty the document")
    )
    out = cut.withColumn("error", error)
    return out.select(
        "path", "heading", F.when(F.col("error").isNull(), F.col("_kept")).alias("text"),
        F.when(F.col("error").isNull(), F.col("_stop") - F.col("start") + 1).alias("lines_removed"), "error",
    )


def drop_documents(docs: DataFrame, drops: DataFrame, path: str = "path", text: str = "text"):
    """Documents left after the drops, and the receipt of lines removed."""
    renamed = drops.select(F.col("path").alias(path)).distinct()
    body = F.regexp_replace(F.col(text), LAST_NEWLINE, "")
    receipt = docs.join(renamed, path, "left_semi").select(
        F.col(path).alias("path"),
        F.when(F.length(text) > 0, F.size(F.split(body, NEWLINE))).otherwise(0).alias("lines_removed"),
    )
    return docs.join(renamed, path, "left_anti"), receipt


def file_digests(docs: DataFrame, path: str, content: str) -> DataFrame:
    return docs.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def set_digest(digests: DataFrame, by: list[str]) -> DataFrame:
    """First 12 hex digits of the digest over the sorted "path, hash" lines of each set.

    Sixty-four hex digits per file travel, never its content. A set is one specification, a
    handful of files; its lines form one value because the digest is taken over all of them.
    """
    line = F.concat("path", F.lit("\n"), "sha256", F.lit("\n"))
    return digests.groupBy(*by).agg(
        F.count("*").alias("files"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))),
                                 lambda s: s["line"]), "").alias("_all"),
    ).select(*by, "files", F.substring(F.sha2("_all", 256), 1, 12).alias("digest"))
