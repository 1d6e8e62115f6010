"""Accuracy by stage, by arm and by question, from graded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landledger.operators.grading import CORRECT, NEAR_MISS
from landledger.plans.skew import top_per_group
from landledger.session import cut_lineage

SCORED = ["done", "incomplete"]


def transitive_dependencies(questions: DataFrame) -> DataFrame:
    """(qid, dep) over all paths, however long. Questions that depend on themselves are an error.

    Paths double in length each round, until a round finds no new pair. The spec's table is small; each round is
    checkpointed, so the plan does not grow with the rounds.
    """
    paths = cut_lineage(questions.select("qid", F.explode("depends_on").alias("dep")).distinct())
    known = paths.count()
    while True:
        onward = paths.select(F.col("qid").alias("dep"), F.col("dep").alias("_next"))
        further = paths.join(onward, "dep").select("qid", F.col("_next").alias("dep"))
        paths = cut_lineage(paths.unionByName(further).distinct())
        loops = paths.filter("qid = dep").select("qid").limit(1).collect()
        if loops:
            raise ValueError(f"{loops[0].qid} depends on itself")
        found = paths.count()
        if found == known:
            return paths
        known = found


def eligible(grades: DataFrame, questions: DataFrame) -> DataFrame:
    """(run, qid) whose every transitive dependency graded correct in that run."""
    paths = transitive_dependencies(questions)
    needed = paths.groupBy("qid").agg(F.count("*").alias("needed"))
    right = grades.filter(F.col("outcome") == CORRECT).select("run", F.col("qid").alias("dep"))
    met = right.join(paths, "dep").groupBy("run", "qid").agg(F.count("*").alias("met"))
    return (
        grades.select("run", "qid").join(needed, "qid", "left").join(met, ["run", "qid"], "left")
        .filter(F.coalesce("met", F.lit(0)) == F.coalesce("needed", F.lit(0)))
        .select("run", "qid")
    )


def stage_accuracy(grades: DataFrame, questions: DataFrame) -> DataFrame:
    """Raw and conditional accuracy per run and stage; conditional is null when nothing was eligible.

    ``grades`` hold one row per run and question of the spec.
    """
    fair = eligible(grades, questions).withColumn("fair", F.lit(True))
    right = F.col("outcome") == CORRECT
    marked = grades.join(questions.select("qid", "stage"), "qid").join(fair, ["run", "qid"], "left")
    return marked.groupBy("run", "stage").agg(
        F.count("*").alias("n"),
        F.avg(right.cast("double")).alias("raw"),
        F.count("fair").alias("n_eligible"),
        F.avg(F.when(F.col("fair"), right.cast("double"))).alias("conditional"),
    )


def stage_means(stages: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean raw and conditional accuracy per group and stage; nulls do not count."""
    return stages.join(runs.select("run", *by), "run").groupBy(*by, "stage").agg(
        F.avg("raw").alias("raw"), F.avg("conditional").alias("conditional")
    )


def is_scored() -> Column:
    return F.coalesce("status", F.lit("done")).isin(SCORED)


def is_regraded() -> Column:
    ran, scored = F.nullif("golden_fingerprint", F.lit("")), F.nullif("graded_against", F.lit(""))
    return F.coalesce(ran != scored, F.lit(False))


def arm() -> Column:
    return F.coalesce(F.nullif("arm", F.lit("")), F.lit("full"))


def run_accuracy(grades: DataFrame) -> DataFrame:
    return grades.groupBy("run").agg(
        F.avg((F.col("outcome") == CORRECT).cast("double")).alias("accuracy"),
        F.count_if(F.col("outcome") == CORRECT).alias("correct"),
        F.count_if(F.col("outcome") == NEAR_MISS).alias("near_miss"),
        F.count("*").alias("total"),
    )


def session_table(meta: DataFrame, grades: DataFrame) -> DataFrame:
    """One row per scored and graded run: accuracy beside cost and time."""
    zero = F.lit(0.0)
    scored = meta.filter(is_scored()).join(run_accuracy(grades), "run")
    duration, slow = F.coalesce("duration_seconds", zero), F.coalesce("slow_tool_seconds", zero)
    return scored.select(
        "model", "run", F.coalesce("label", F.lit("")).alias("label"), "accuracy", "correct", "near_miss", "total",
        F.coalesce("imputed_cost_usd", zero).alias("cost_usd"), F.coalesce("turns", F.lit(0)).alias("turns"),
        duration.alias("duration_seconds"), slow.alias("slow_tool_seconds"),
        F.coalesce("timed_out_tool_calls", F.lit(0)).alias("timed_out_tool_calls"),
        F.when(duration > 0, slow / duration).otherwise(zero).alias("slow_tool_share"),
    )


def model_summary(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("model").agg(
        F.count("*").alias("passes"),
        F.avg("accuracy").alias("mean_accuracy"), F.min("accuracy").alias("min_accuracy"),
        F.max("accuracy").alias("max_accuracy"), F.avg("near_miss").alias("mean_near_miss"),
        F.avg("cost_usd").alias("mean_cost"),
    )


def runtime_by_model(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("model").agg(
        F.avg("duration_seconds").alias("mean_seconds"),
        F.avg("slow_tool_share").alias("mean_slow_share"),
        F.sum("timed_out_tool_calls").alias("timed_out_calls"),
    )


def score_cost_points(sessions: DataFrame) -> DataFrame:
    return sessions.select("model", "run", "cost_usd", "accuracy")


def cost_frontier(points: DataFrame, buckets: int = 256) -> DataFrame:
    """Best accuracy that any run up to each point's cost reached, and whether the point set it.

    Points of one cost are one value first. Costs are dealt to buckets by approximate quantiles, which decide the balance
    only; the best of all cheaper buckets is carried into each.
    """
    best = points.groupBy("cost_usd").agg(F.max("accuracy").alias("here"))
    borders = best.agg(F.percentile_approx("cost_usd", [k / buckets for k in range(1, buckets)])).scalar()
    dealt = best.withColumn("_borders", borders)
    dealt = dealt.withColumn("_bucket", F.coalesce(F.size(F.filter("_borders", lambda b: b < F.col("cost_usd"))), F.lit(0))).drop("_borders")
    cheaper = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most `buckets` rows
    carried = dealt.groupBy("_bucket").agg(F.max("here").alias("_most")).select("_bucket", F.max("_most").over(cheaper).alias("_carried"))
    inside = Window.partitionBy("_bucket").orderBy("cost_usd").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.withColumn("_inside", F.max("here").over(inside)).join(F.broadcast(carried), "_bucket")
    reached = before.select("cost_usd", "here", F.greatest("_inside", "_carried").alias("before"))
    met = points.join(reached, "cost_usd")
    sets = (F.col("accuracy") == F.col("here")) & F.coalesce(F.col("accuracy") > F.col("before"), F.lit(True))
    return met.select(*points.columns, F.greatest("here", "before").alias("best_so_far"), sets.alias("on_frontier"))


def exclusions(meta: DataFrame, grades: DataFrame) -> DataFrame:
    """Runs left out of the arm table and why; the first reason that applies."""
    graded = grades.select("run", F.lit(True).alias("graded")).distinct()
    reason = (
        F.when(~is_scored(), F.col("status"))
        .when(is_regraded(), "regraded")
        .when(F.col("graded").isNull(), "not graded")
    )
    return meta.join(graded, "run", "left").withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "model", "run", "reason"
    )


def arm_runs(meta: DataFrame, grades: DataFrame) -> DataFrame:
    """Runs kept, with their arm and spec digest; two specs under one name stay apart."""
    return meta.join(exclusions(meta, grades), "run", "left_anti").select(
        "model", "run", arm().alias("arm"), F.col("spec_fingerprint").alias("spec")
    )


def arm_accuracy(meta: DataFrame, grades: DataFrame) -> DataFrame:
    kept = arm_runs(meta, grades)
    return kept.join(run_accuracy(grades), "run").groupBy("model", "arm", "spec").agg(
        F.count("*").alias("runs"), F.avg("accuracy").alias("mean"),
        F.min("accuracy").alias("lo"), F.max("accuracy").alias("hi"),
    )


def question_delta(meta: DataFrame, grades: DataFrame, baseline: str = "full") -> DataFrame:
    """Pass rate per question and arm against the baseline, in points.

    A baseline whose spec digest is known is preferred. Questions on which no arm moves
    by a point or more are left out.
    """
    kept = arm_runs(meta, grades)
    rates = (
        grades.join(kept, "run").groupBy("model", "arm", "spec", "qid")
        .agg(F.avg((F.col("outcome") == CORRECT).cast("double")).alias("rate"))
    )
    arms = kept.select("model", "arm", "spec").distinct()
    base = top_per_group(
        arms.filter(F.col("arm") == baseline), ["model"], [F.col("spec").isNull(), F.col("spec").asc_nulls_last()]
    ).drop("rank")
    is_base = (F.col("r.arm") == F.col("b.arm")) & F.col("r.spec").eqNullSafe(F.col("b.spec"))
    beside = rates.alias("r").join(base.alias("b"), F.col("r.model") == F.col("b.model"))
    base_rate = beside.filter(is_base).select("r.model", "r.qid", F.col("r.rate").alias("base_rate"))
    others = beside.filter(~is_base).select("r.*")
    compared = others.join(base_rate, ["model", "qid"], "left").withColumn(
        "delta", (F.col("rate") - F.col("base_rate")) * 100
    )
    moved = compared.groupBy("model", "qid").agg(F.max(F.abs(F.col("delta"))).alias("_most")).filter(F.col("_most") >= 1)
    return compared.join(moved.select("model", "qid"), ["model", "qid"], "left_semi")


def missing_answers(expected: DataFrame, written: DataFrame) -> DataFrame:
    """Questions a run has not answered; both sides are (run, qid)."""
    return expected.join(written, ["run", "qid"], "left_anti")


def verdicts(expected: DataFrame, written: DataFrame) -> DataFrame:
    """How each run ended: with nothing, part or all of its answers."""
    marked = expected.join(written.select("run", "qid", F.lit(1).alias("have")).distinct(), ["run", "qid"], "left")
    per = marked.groupBy("run").agg(F.count("*").alias("expected"), F.count("have").alias("answered"))
    return per.withColumn(
        "verdict",
        F.when(F.col("answered") == 0, "produced_nothing")
        .when(F.col("answered") < F.col("expected"), "incomplete").otherwise("done"),
    )
