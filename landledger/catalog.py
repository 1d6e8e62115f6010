"""Every query by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger import derive as D
from landledger.functions import cells as K
from landledger.functions import geometry as G
from landledger.functions.projection import distance_km, polyconic
from landledger.functions.wkb import from_wkb, to_wkb
from landledger.operators import agreement as A
from landledger.operators import candidates as C
from landledger.operators import corpus as T
from landledger.operators import defects as X
from landledger.operators import grading as Q
from landledger.operators import match as M
from landledger.operators import resolve as R
from landledger.operators import rollups as V
from landledger.operators import stages as S
from landledger.operators import usage as U
from landledger.plans.spread import spread
from landledger.plans.stages import Stages
from landledger.policy import METRES_PER_DEGREE, price_table
from landledger.portfolio import Portfolio
from landledger.readback import QUERIES as READ_BACK
from landledger.sources.lists import read_list
from landledger.streaming import windows as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def view(name: str, build: Callable[[Portfolio], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Portfolio(spark, sf_dir))


# -- list resolution -----------------------------------------------------------------

view("resolve_list", lambda p: p.resolved)
view("list_reconciliation", lambda p: R.reconciliation(p.resolved))
view("parcel_resolution", lambda p: R.resolution_counts(p.resolved, p.cad))
view("listed_parcels", lambda p: p.cad.select("row_key", "cod_imovel", "municipio"))
view("muni_counts", lambda p: R.municipality_counts(p.cad))
view("dup_ids_and_small", lambda p: R.quality_counts(p.cad))
view("distinct_ids", lambda p: V.row_and_id_counts(p.parcels))
view("tier_counts", lambda p: V.tier_counts(p.facilities))
view("field_rows_epsg", lambda p: V.row_count_and_epsg(p.raw_fields))
view(
    "point_in_parcel",
    lambda p: p.resolution.hits.filter("contains").groupBy("row_id").agg(
        F.count("*").alias("n_parcels"), F.min("cod_imovel").alias("cod_imovel")
    ),
)


@query
def defect_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    donors = {"duplicate": "S0-10-10", "centroid": "S1-11-11", "geometry": "S2-12-12", "axis_flip": "S3-13-13"}
    made = X.inject(Portfolio(spark, sf_dir).parcels, donors)
    return made.select(
        "cod_imovel", "municipio", "cod_estado", "defect", "resolves_to",
        F.split_part("geometry", F.lit(" "), F.lit(1)).alias("kind"),
    )


@query
def list_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list written as CSV and read again: what each row holds, and which rows are copies."""
    portfolio = Portfolio(spark, sf_dir)
    listed = portfolio.stages.table("list", lambda: D.dirty_list(spark, sf_dir, portfolio.parcels))
    folder = f"{portfolio.stages.root}/list-csv"
    rows = listed.select(F.col("raw_id").alias("cod_imovel"), F.col("raw_wkt").alias("geometry"), F.col("row_id").alias("place"))
    rows.repartitionByRange(4, "place").sortWithinPartitions("place").drop("place").write.mode("overwrite").csv(folder, header=True)
    prepared = R.prepare(read_list(spark, "csv", folder), portfolio.policy)
    return prepared.groupBy(F.col("raw_id").isNotNull().alias("named"), F.coalesce("geometry.kind", F.lit("")).alias("kind"), "axis_flipped", "duplicate").agg(
        F.count("*").alias("n_rows"), F.count("geometry.rings").alias("n_shapes")
    )


@query
def wkb_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines through well-known binary and back."""
    packed = D.outlines(spark, sf_dir).select("row_key", to_wkb(F.col("geometry")).alias("wkb"))
    shape = packed.select("row_key", from_wkb("wkb").alias("geometry"))
    return G.with_shape(shape).select("row_key", F.round("area", 6).alias("area"), "xmin", "ymin", "xmax", "ymax")


# -- matching ------------------------------------------------------------------------

view("envelope_clip", lambda p: V.envelope_count(p.fields))
view(
    "field_attributes",
    lambda p: p.fields.select(
        "Id", "field_area_ha", "mb_class", "band_loss_area", F.round("cleared_share", 6).alias("cleared_share"),
        "defor_era", "post2020_loss_ha", "has_post2020_loss",
    ),
)
view("spatial_overlap", lambda p: p.overlaps)
view(
    "containment_primary_tie",
    lambda p: M.primary_parcel(p.overlaps, p.policy).withColumn("max_single_frac", F.round("max_single_frac", 9)),
)
view("union_containment", lambda p: p.union.withColumn("union_frac", F.round("union_frac", 9)))
view(
    "match_decision",
    lambda p: p.decision.withColumns(
        {"max_single_frac": F.round("max_single_frac", 9), "union_frac": F.round("union_frac", 9)}
    ),
)
view("match_count", lambda p: V.match_count(p.matched))
view("match_reconciliation", lambda p: V.match_reconciliation(p.matched))
view("match_excluded", lambda p: M.excluded_count(p.decision))
view("dominant_class", lambda p: M.dominant_class(p.matched))
view(
    "parcel_rollup",
    lambda p: p.enriched.select(
        "cod_imovel", "row_key", "n_fields", "matched_field_ha", "post2020_loss_ha", "n_fields_post2020_loss",
        "deforestation_free", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "dominant_mb",
    ),
)
view("parcel_field_topk", lambda p: V.parcels_with_most_fields(p.enriched))
view("per_parcel_report", lambda p: V.per_parcel(p.enriched))
view("list_overview", lambda p: V.list_overview(p.matched, p.enriched))
view("classes_present", lambda p: V.classes_present(p.matched, p.scope))
view("loss_by_commodity", lambda p: V.loss_by_commodity(p.matched, p.scope))
view("loss_excluded", lambda p: V.loss_excluded(p.matched, p.scope))
view("area_share_by_commodity", lambda p: V.area_by_commodity(p.matched, p.scope))
view("worst_parcels", lambda p: V.worst_parcels(p.matched, p.enriched, p.scope))
view("worst_plots", lambda p: V.worst_plots(p.matched, p.scope))
view("loss_by_era", lambda p: V.loss_by_era(p.matched))
view("lossyear_histogram", lambda p: V.loss_year_histogram(p.matched))
view("crop_breakdown", lambda p: V.crop_breakdown(p.matched))
view("legality_status", lambda p: V.legality_status(p.enriched))

def _shapes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fields and parcels that are no boxes, written once: the matching steps read them several times."""
    stages = Stages.of(spark, sf_dir, "outlines")
    return stages.table("patches", lambda: D.patches(spark, sf_dir)), stages.table("outlines", lambda: D.outlines(spark, sf_dir))


@query
def polygon_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area shared by fields and parcels that are no boxes."""
    fields, parcels = _shapes(spark, sf_dir)
    found = M.overlaps(fields, parcels, D.PLANE)
    return found.filter("inter_area > 1e-9").withColumn("inter_area", F.round("inter_area", 6)).withColumn("field_area", F.round("field_area", 6))


@query
def polygon_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each such field inside the union of all such parcels."""
    shares = M.union_fraction(*_shapes(spark, sf_dir), D.PLANE, Stages.of(spark, sf_dir, "outlines"))
    return shares.filter("union_frac > 1e-9").withColumn("union_frac", F.round("union_frac", 6))


@query
def polygon_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points strictly inside parcels that are no boxes."""
    k = F.col("c_custkey")
    places = D.table(spark, sf_dir, "customer").select(k.alias("row_id"), G.point((k * 7) % 1000 + 0.25, -((k * 13) % 200) + 0.25).alias("geometry"))
    points = G.with_shape(places).withColumn("kind", F.col("geometry.kind"))
    return R.touching(points, D.outlines(spark, sf_dir), D.PLANE).filter("contains").select("row_id", "row_key", "cod_imovel")


@query
def buffered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of strips inside the union of bands, each band widened by one unit on either side."""
    policy = replace(D.PLANE, neighbor_gap_tolerance_m=METRES_PER_DEGREE)
    stages = Stages.of(spark, sf_dir, "bands")
    shares = M.union_fraction(D.strips(spark, sf_dir), D.bands(spark, sf_dir), policy, stages)
    return shares.filter("union_frac > 1e-9").withColumn("union_frac", F.round("union_frac", 6))


# -- contacts ------------------------------------------------------------------------

view(
    "membership_candidates",
    lambda p: C.membership(p.cadasters, p.facilities).select("cod_imovel", "cod_ibge", "entity_id", "evidence_value"),
)
view(
    "delivery_widening",
    lambda p: C.delivery(p.cadasters, p.facilities, p.policy, p.stages).select(
        "cod_imovel", "entity_id", "tier", F.round("distance_km", 6).alias("distance_km"),
        F.round("radius_km", 6).alias("radius_km"), "flags",
    ),
)
view(
    "catchment_candidates",
    lambda p: C.catchments(p.cadasters, p.facilities, p.policy.cell).select("cod_imovel", "entity_id"),
)
view("allowed_tiers", lambda p: C.allowed_tiers(p.cadasters, p.scope, p.routing))
view(
    "candidates_ranked",
    lambda p: p.candidates.select(
        "cod_imovel", "rank", "entity_id", "entity_kind", "tier", "basis",
        F.round("distance_km", 6).alias("distance_km"), "evidence_value", "flags",
    ),
)
view("candidate_report", lambda p: V.candidate_list(p.candidates))
view("nearest_delivery", lambda p: V.nearest_delivery(p.candidates, p.flagged))
view("membership_of_flagged", lambda p: V.membership_of_flagged(p.candidates, p.flagged))
view("candidate_reconciliation", lambda p: V.candidate_reconciliation(p.flagged, p.candidates))
view("candidate_reconciliation_all", lambda p: V.candidate_reconciliation(p.enriched, p.candidates))
view("candidate_summary", lambda p: V.candidate_summary(p.flagged, p.candidates))
view("coverage", lambda p: V.coverage(p.matched, p.scope, p.routing))
view("routing", lambda p: V.routing_of_flagged(p.matched, p.enriched, p.scope, p.routing))
view("portfolio", lambda p: V.portfolio(p.matched, p.enriched, p.candidates, p.scope))


@query
def polyconic_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and least distance from each customer to the suppliers of its orders."""

    def place(key: str):
        k = F.col(key)
        return polyconic(k % 1900 / 100.0 - 64, -(k % 2300) / 100.0 - 3)

    lines = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    pairs = lines.join(orders, "l_orderkey")
    return pairs.withColumn("km", distance_km(*place("o_custkey"), *place("l_suppkey"))).groupBy("o_custkey").agg(
        F.round(F.avg("km"), 4).alias("mean_km"), F.round(F.min("km"), 4).alias("least_km")
    )


# -- grading -------------------------------------------------------------------------

@query
def cell_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written seven ways against the cell they should equal."""
    n, price, flag = F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_returnflag")
    quantity = F.col("l_quantity").cast("bigint")
    text = price.cast("string")
    golden = (
        F.when(n == 5, F.when(flag == "A", "true").otherwise("False"))
        .when(n == 6, F.concat(F.lit("kind "), flag))
        .when(n == 7, quantity.cast("string"))
        .otherwise(text)
    )
    answer = (
        F.when(n == 1, text)
        .when(n == 2, (price * 1.0005).cast("string"))
        .when(n == 3, (price * 1.005).cast("string"))
        .when(n == 4, F.when(quantity % 2 == 0, F.lit("n/a")).otherwise((price * 1.02).cast("string")))
        .when(n == 5, F.when(quantity % 3 == 0, "yes").when(quantity % 3 == 1, "0").otherwise(" F "))
        .when(n == 6, F.concat(F.lit(" KIND "), F.when(quantity % 2 == 0, F.lower(flag)).otherwise(F.lit("?"))))
        .otherwise((quantity + quantity % 4).cast("string"))
    )
    lines = D.table(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_extendedprice", "l_returnflag", "l_quantity"
    )
    cells = spread(lines).select(
        "l_linenumber", K.parse(answer).alias("a"), K.parse(golden).alias("g")
    )
    a, g = F.col("a"), F.col("g")
    no, yes = F.lit(False), F.lit(True)
    return cells.groupBy("l_linenumber").agg(
        F.count("*").alias("cells"),
        F.count_if(K.matches(a, g, no)).alias("strict"),
        F.count_if(K.matches(a, g, yes)).alias("geometry"),
        F.count_if(K.matches(a, g, no, K.NEAR_MISS_FACTOR)).alias("near_miss"),
    )


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        header = F.array(F.lit("part"), F.lit("type"), F.lit("price"))
        golden = D.golden_tables(spark, sf_dir).select("qid", "row_no", "cells")
        asked = golden.select("qid", F.lit(False).alias("geometry"), header.alias("header")).distinct()
        answers = D.answer_tables(spark, sf_dir).select("run", "qid", "row_no", "cells")
        return Q.grade(D.expected_answers(spark, sf_dir), answers, golden, asked, Stages.of(spark, sf_dir))

    return Stages.of(spark, sf_dir).table("graded", build)


@query
def grade_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("run", "qid", "outcome")


@query
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.outcome_counts(_graded(spark, sf_dir))


@query
def grade_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.diff_rows(_graded(spark, sf_dir)).select(
        "run", "qid", "kind", "row", "column", "rel_error", "near_miss", "golden_rows", "answer_rows"
    )


@query
def grade_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.diff_summary(Q.diff_rows(_graded(spark, sf_dir))).select("run", "qid", "n_cells", "summary")


@query
def identical_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact multiset comparison of each answer with its golden table."""
    given = D.answer_tables(spark, sf_dir).select("run", "qid", "cells")
    runs = D.expected_answers(spark, sf_dir).select("run", "qid")
    golden = D.golden_tables(spark, sf_dir).select("qid", "cells").join(runs, "qid").select("run", "qid", "cells")
    return Q.identical_tables(given, golden, ["run", "qid"])


@query
def session_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written per supplier run; a run of an even key loses its answers graded missing."""
    grades = D.grades(spark, sf_dir)
    written = grades.filter((F.col("outcome") != "missing") | (F.col("run") % 2 == 1)).select("run", "qid")
    return S.verdicts(grades.select("run", "qid"), written)


@query
def missing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions graded missing, as the difference of what was asked and what was written."""
    grades = D.grades(spark, sf_dir)
    return S.missing_answers(grades.select("run", "qid"), grades.filter(F.col("outcome") != "missing").select("run", "qid"))


def _with_grades(name: str, build) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grades = Stages.of(spark, sf_dir).table("grades", lambda: D.grades(spark, sf_dir))
        return build(D.run_meta(spark, sf_dir), grades, D.questions(spark))

    QUERIES[name] = run


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


_with_grades("eligible_questions", lambda meta, grades, qs: S.eligible(grades, qs))
@query
def eligible_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain as long as the nation table: each nation depends on the one before; suppliers answer all of them."""
    nations = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    before = F.when(F.col("n") > 0, F.array(F.col("n") - 1)).otherwise(F.array().cast("array<bigint>"))
    chain = nations.select(F.col("n").cast("string").alias("qid"), before.cast("array<string>").alias("depends_on"))
    count = F.sequence(F.lit(0).cast("bigint"), nations.agg(F.max("n").cast("bigint")).scalar())
    runs = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), F.explode(count).alias("n"))
    right = (F.col("run") * 7 + F.col("n")) % 23 != 0
    grades = runs.select("run", F.col("n").cast("string").alias("qid"), F.when(right, "correct").otherwise("wrong").alias("outcome"))
    return S.eligible(grades, chain)


_with_grades("stage_accuracy", lambda meta, grades, qs: _rounded(S.stage_accuracy(grades, qs)))
_with_grades(
    "stage_means",
    lambda meta, grades, qs: _rounded(S.stage_means(S.stage_accuracy(grades, qs), meta.filter(S.is_scored()), ["model"])),
)
_with_grades("session_summary", lambda meta, grades, qs: _rounded(S.session_table(meta, grades)))
_with_grades("model_summary", lambda meta, grades, qs: _rounded(S.model_summary(S.session_table(meta, grades))))
_with_grades("runtime_by_model", lambda meta, grades, qs: _rounded(S.runtime_by_model(S.session_table(meta, grades))))
_with_grades("score_cost_points", lambda meta, grades, qs: _rounded(S.score_cost_points(S.session_table(meta, grades))))
_with_grades("cost_frontier", lambda meta, grades, qs: _rounded(S.cost_frontier(S.score_cost_points(S.session_table(meta, grades)))))
_with_grades("excluded_runs", lambda meta, grades, qs: S.exclusions(meta, grades))
_with_grades("arm_accuracy", lambda meta, grades, qs: _rounded(S.arm_accuracy(meta, grades)))
_with_grades("question_delta", lambda meta, grades, qs: _rounded(S.question_delta(meta, grades)))


# -- agreement -----------------------------------------------------------------------

def _with_artifacts(name: str, build) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Stages.of(spark, sf_dir).table("artifacts", lambda: A.load_artifacts(D.artifacts_raw(spark, sf_dir)))
        return build(rows, Stages.of(spark, sf_dir))

    QUERIES[name] = run


def _oracle_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("run = 0").select("cod_imovel", "loss", "contact")


_with_artifacts("artifact_load", lambda rows, stages: rows)
_with_artifacts("pairwise_jaccard", lambda rows, stages: _rounded(A.pairwise_jaccard(rows)))
_with_artifacts("unstable_set", lambda rows, stages: A.unstable_parcels(rows))
_with_artifacts("kendall_tau", lambda rows, stages: _rounded(A.kendall_tau(rows, stages)))
_with_artifacts("fleiss_kappa", lambda rows, stages: _rounded(A.contact_kappa(rows)))
_with_artifacts("modal_agreement", lambda rows, stages: _rounded(A.contact_agreement(rows)))
_with_artifacts("loss_cv", lambda rows, stages: _rounded(A.loss_variation(rows)))
_with_artifacts("oracle_agreement", lambda rows, stages: _rounded(A.oracle_agreement(rows, _oracle_rows(rows))))
_with_artifacts("consistency_report", lambda rows, stages: _rounded(A.consistency(rows, _oracle_rows(rows), stages)))


# -- transcripts ---------------------------------------------------------------------

@query
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = U.usage_totals(D.transcript(spark, sf_dir))
    models = F.array(F.lit("haiku"), F.lit("sonnet"), F.lit("opus"))
    with_model = totals.withColumn("model", F.get(models, (F.col("run") % 3).cast("int")))
    return _rounded(U.imputed_cost(with_model, price_table(spark)), 9)


@query
def slow_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.slow_calls_by_tool(U.longest_calls(D.transcript(spark, sf_dir)))


@query
def tool_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = D.transcript(spark, sf_dir)
    per_run = U.tool_timings(U.longest_calls(records), records)
    told = F.transform(F.map_entries("slow_tool_seconds_by_tool"), lambda e: F.format_string("%s=%.1f", e["key"], e["value"]))
    return per_run.withColumn("by_tool", F.array_join(told, ";")).drop("slow_tool_seconds_by_tool")


@query
def last_session_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.last_seen(D.transcript(spark, sf_dir), "session_id")


@query
def session_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.progress(D.transcript(spark, sf_dir))


@query
def credential_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.credential_rejected(D.transcript(spark, sf_dir))


@query
def call_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.call_pairs(D.call_records(spark, sf_dir)).select("run", "tool_use_id", "tool", "failed", "seconds")


@query
def heartbeat_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = D.transcript(spark, sf_dir).filter("type = 'tool_progress'")
    return U.heartbeats(beats.withColumn("seconds", F.col("elapsed_time_seconds")))


@query
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sortable names of runs started on the order dates."""
    orders = D.table(spark, sf_dir, "orders")
    commit = F.md5(F.col("o_orderkey").cast("string"))
    return orders.select("o_orderkey", U.run_id(F.col("o_orderdate").cast("timestamp"), commit).alias("run"))


@query
def call_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each call is about, from inputs of several forms."""
    k, e = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_id").cast("string")
    given = [
        (k % 5 == 0, F.create_map(F.lit("command"), F.concat(F.lit(" run  "), e, F.lit("\n-x ")), F.lit("path"), F.lit("/unused"))),
        (k % 5 == 1, F.create_map(F.lit("file_path"), F.concat(F.lit("/data/in/"), e, F.lit("/table.csv")))),
        (k % 5 == 2, F.create_map(F.lit("command"), F.lit("  "), F.lit("pattern"), F.concat(F.lit("a/b/c/d/"), e))),
        (k % 5 == 3, F.create_map(F.lit("path"), F.concat(F.lit("in/"), e))),
    ]
    payload = F.create_map(F.lit("other"), e)
    for when, value in reversed(given):
        payload = F.when(when, value).otherwise(payload)
    return D.table(spark, sf_dir, "events").select("event_id", U.tool_subject(payload).alias("subject"))


@query
def truncation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.truncation_stats(D.range_readings(spark, sf_dir), ["route"], digits=6)


# -- time windows --------------------------------------------------------------------

def _windows(windows: DataFrame, keys: list[str]) -> DataFrame:
    stamps = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("opened", "closed")]
    return W.rates(windows).select(*stamps, *keys, "events", *[F.round(c, 6).alias(c) for c in ("value", "most", "per_hour", "mean")])


@query
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per type and hour."""
    return _windows(W.tumbling(D.table(spark, sf_dir, "events"), "1 hour", ["event_type"]), ["event_type"])


@query
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per type over a day, told every six hours."""
    return _windows(W.sliding(D.table(spark, sf_dir, "events"), "1 day", "6 hours", ["event_type"]), ["event_type"])


@query
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events less than six hours apart."""
    return _windows(W.sessions(D.table(spark, sf_dir, "events"), "6 hours", ["user_id"]), ["user_id"])


# -- documents -----------------------------------------------------------------------

@query
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.secret_scan(D.committed_files(spark, sf_dir))


@query
def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.section_index(D.markdown(spark, sf_dir))


@query
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.section_ranges(T.section_index(D.markdown(spark, sf_dir)))


@query
def section_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.markdown(spark, sf_dir)
    cut = T.cut_sections(docs, docs.select("path", F.lit("T3").alias("heading")))
    return cut.select("path", "heading", "lines_removed", "error", F.md5("text").alias("text_md5"))


@query
def tidy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n \n")), F.lit("\n\n"))
    return D.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.tidy(loose)).alias("text_md5"))


@query
def document_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed by dropping the documents labelled toxic."""
    docs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    drops = D.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("path"))
    return T.drop_documents(docs, drops)[1]


@query
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 20).alias("spec"), F.col("doc_id").cast("string").alias("path"), "text"
    )
    hashed = docs.select("spec", "path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return T.set_digest(hashed, ["spec"])


QUERIES |= READ_BACK
