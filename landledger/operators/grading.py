"""Grading many answer tables against golden tables, and explaining every differing cell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.functions import cells as C
from landledger.functions.pairing import both_columns, cell_differences, grid_of, same_table
from landledger.plans.stages import Stages
from landledger.session import kernel_partitions

CORRECT, NEAR_MISS, WRONG = "correct", "near_miss", "wrong"
MISSING, UNPARSEABLE = "missing", "unparseable"
OUTCOMES = [CORRECT, NEAR_MISS, WRONG, MISSING, UNPARSEABLE]

DIFF = (
    "kind string, row int, column string, golden string, answer string, rel_error double, near_miss boolean, "
    "golden_rows bigint, answer_rows bigint, golden_columns int, answer_columns int"
)
DIFF_STRUCT = ", ".join(f"{p.strip().split(' ')[0]}: {p.strip().split(' ')[1]}" for p in DIFF.split(","))
GRADED = f"run string, qid string, outcome string, diffs array<struct<{DIFF_STRUCT}>>"


def table_shapes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, width, raggedness and an order-free digest per table; ``rows`` are body rows with a cells array.

    Tables whose rows agree as text, in any order, have the same digest: sums over two 64-bit hashes of each row, taken
    by halves so that they cannot overflow. ``odd`` tables hold a nan, which agrees with nothing.
    """
    plain = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n"))))
    hashed = rows.select(*keys, F.size("cells").alias("size"), F.exists(plain, lambda c: c.rlike("^[+-]?nan$")).alias("nan"),
                         *[F.xxhash64(plain, F.lit(k)).alias(f"h{k}") for k in (0, 1)])
    halves = [F.sum(half) for k in (0, 1) for half in (F.shiftright(f"h{k}", 32), F.col(f"h{k}").bitwiseAND(F.lit(0xFFFFFFFF)))]
    return hashed.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.min("size").alias("width"), (F.min("size") != F.max("size")).alias("ragged"),
        F.bool_or("nan").alias("odd"), F.struct(*[h.alias(f"d{k}") for k, h in enumerate(halves)]).alias("digest"),
    )


def _typed(cells: Column) -> Column:
    return F.transform(cells, C.parse)


def grade(expected: DataFrame, answers: DataFrame, golden: DataFrame, questions: DataFrame, stages: Stages | None = None) -> DataFrame:
    """(run, qid, outcome, diffs) for every expected answer.

    expected: run, qid, written (whether a file exists). answers: run, qid, row_no, cells.
    golden: qid, row_no, cells. questions: qid, geometry, header.
    Missing, unreadable and mis-shaped answers, and those that hold the golden's rows as they are in any order, are decided
    by one aggregate over each side, so a runaway answer never reaches a group. A group is one of the others, with exactly
    the golden's number of rows. With ``stages`` what is decided so far is written once and read by both branches.
    """
    want = table_shapes(golden, ["qid"]).select(
        "qid", F.col("n_rows").alias("golden_rows"), F.col("width").alias("golden_columns"), "odd", F.col("digest").alias("golden_digest")
    )
    have = table_shapes(answers, ["run", "qid"]).select(
        "run", "qid", F.col("n_rows").alias("answer_rows"), F.col("width").alias("answer_columns"), "ragged", "digest"
    )
    status = (
        expected.join(have, ["run", "qid"], "left").join(want, "qid").join(questions, "qid")
        .withColumn(
            "outcome",
            F.when(~F.col("written"), MISSING)
            .when(F.col("answer_rows").isNull() | F.col("ragged"), UNPARSEABLE)
            .when(
                (F.col("answer_rows") != F.col("golden_rows")) | (F.col("answer_columns") != F.col("golden_columns")),
                WRONG,
            )
            .when((F.col("digest") == F.col("golden_digest")) & ~F.col("odd"), CORRECT),
        )
        .drop("digest", "golden_digest", "odd", "ragged")
    )
    if stages:
        status = stages.keep("grade-status", status)
    shape = F.struct(
        F.lit("shape").alias("kind"), F.lit(None).cast("int").alias("row"),
        *[F.lit(None).cast("string").alias(c) for c in ("column", "golden", "answer")],
        F.lit(None).cast("double").alias("rel_error"), F.lit(None).cast("boolean").alias("near_miss"),
        F.col("golden_rows"), F.col("answer_rows"), F.col("golden_columns"), F.col("answer_columns"),
    )
    settled = status.filter(F.col("outcome").isNotNull()).select(
        "run", "qid", "outcome",
        F.when(F.col("outcome") == WRONG, F.array(shape)).otherwise(F.array()).cast(f"array<struct<{DIFF_STRUCT}>>")
        .alias("diffs"),
    )
    comparable = status.filter(F.col("outcome").isNull()).select("run", "qid", "geometry", "header")
    # Golden rows go to every run that gave a comparable answer.
    asked = golden.select("qid", "row_no", "cells", F.lit(True).alias("is_golden"))
    given = answers.select("run", "qid", "row_no", "cells", F.lit(False).alias("is_golden"))
    sides = given.join(comparable, ["run", "qid"]).unionByName(
        asked.join(comparable, "qid").select("run", "qid", "row_no", "cells", "is_golden", "geometry", "header")
    ).withColumn("cells", _typed(F.col("cells")))
    spread = sides.repartition(kernel_partitions(sides.sparkSession), "run", "qid")
    compared = spread.groupBy("run", "qid").applyInPandas(_grade_one, GRADED)
    return settled.unionByName(compared)


def _grade_one(group: pd.DataFrame) -> pd.DataFrame:
    first = group.iloc[0]
    group = group.sort_values("row_no")
    answer = [list(c) for c in group.loc[~group["is_golden"], "cells"]]
    golden = [list(c) for c in group.loc[group["is_golden"], "cells"]]
    geometry = bool(first["geometry"])
    columns = both_columns(answer, golden)
    strict = grid_of(*columns, geometry, 1.0)
    if same_table(strict):
        outcome, diffs = CORRECT, []
    else:
        near = grid_of(*columns, geometry, float(C.NEAR_MISS_FACTOR), strict)
        outcome = NEAR_MISS if same_table(near) else WRONG
        diffs = cell_differences(answer, golden, strict, near, list(first["header"]))
    blank = dict.fromkeys(("golden_rows", "answer_rows", "golden_columns", "answer_columns"))
    rows = [{**d, **blank} for d in diffs]
    return pd.DataFrame({"run": [first["run"]], "qid": [first["qid"]], "outcome": [outcome], "diffs": [rows]})


def diff_rows(graded: DataFrame) -> DataFrame:
    return graded.select("run", "qid", F.explode("diffs").alias("d")).select("run", "qid", "d.*")


def diff_summary(diffs: DataFrame) -> DataFrame:
    """Cells, columns and worst error per failed question."""
    per = diffs.groupBy("run", "qid").agg(
        F.count("*").alias("n_cells"),
        F.array_sort(F.collect_set("column")).alias("columns"),
        F.max("rel_error").alias("worst_error"),
        F.max(F.when(F.col("kind") == "shape", F.format_string(
            "shape: golden %dx%d, answer %dx%d", "golden_rows", "golden_columns", "answer_rows", "answer_columns"
        ))).alias("shape"),
    )
    worst = F.coalesce(F.concat(F.lit(", worst "), F.format_number(F.col("worst_error") * 100, 1), F.lit("%")), F.lit(""))
    cells = F.concat(F.col("n_cells").cast("string"), F.lit(" cells in "), F.array_join("columns", ", "), worst)
    return per.withColumn("summary", F.coalesce("shape", cells)).drop("shape")


def outcome_counts(grades: DataFrame) -> DataFrame:
    """One row per run with the number of questions per outcome."""
    return grades.groupBy("run").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def identical_tables(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows agree as exact multisets.

    Rows are dealt by their keys first, since few are copies: both counts then run where a key's rows lie, and no task
    holds more of them than a shuffle partition does, however few splits the input has.
    """
    columns = [c for c in left.columns if c not in keys]
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1))).repartition(*keys)
    per_row = signed.groupBy(*keys, *columns).agg(F.sum("_n").alias("_n"))
    return per_row.groupBy(*keys).agg((F.max(F.abs(F.col("_n"))) == 0).alias("identical"))
