"""The question views over matched fields, enriched parcels and ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.plans.skew import share_of_total, top_per_group
from landledger.policy import DELIVERY_TIERS, ERAS, MEMBERSHIP, STATUS_LABELS



def scoped(matched: DataFrame, scope: DataFrame, how: str = "inner") -> DataFrame:
    """Matched fields beside their policy row. The policy table is fixed and tiny."""
    policy = scope.select(
        F.col("mbmode24").alias("_class"), F.col("mb_class").alias("policy_class"),
        "annex1_commodity", "in_scope", "caveat",
    )
    keyed = matched.withColumn("_class", F.col("mbmode24").cast("int"))
    return keyed.join(F.broadcast(policy), "_class", how).drop("_class")


def in_scope(matched: DataFrame, scope: DataFrame) -> DataFrame:
    return scoped(matched, scope).filter("in_scope")


def flagged(matched: DataFrame, scope: DataFrame) -> DataFrame:
    """Parcel ids holding a regulated field with loss after the cut-off."""
    return in_scope(matched, scope).filter("has_post2020_loss").select("cod_imovel").distinct()


# -- sources -----------------------------------------------------------------

def row_and_id_counts(parcels: DataFrame) -> DataFrame:
    return parcels.agg(F.count("*").alias("n_rows"), F.count_distinct("cod_imovel").alias("n_distinct_ids"))


def tier_counts(facilities: DataFrame) -> DataFrame:
    return facilities.groupBy("tier").agg(F.count("*").alias("n")).orderBy("tier")


def row_count_and_epsg(fields: DataFrame, epsg: int = 4326) -> DataFrame:
    return fields.agg(F.count("*").alias("n_rows")).withColumn("epsg", F.lit(epsg))


def catalog_children(catalog: DataFrame, recommended: str = "trazo3-fields") -> DataFrame:
    """How many child links of a catalogue document are collections."""
    links = catalog.select(F.explode("links").alias("link"))
    return links.agg(
        F.count_if((F.col("link.rel") == "child") & F.col("link.href").endswith("collection.json"))
        .cast("int").alias("n_collections")
    ).withColumn("recommended_id", F.lit(recommended))


def envelope_count(clipped: DataFrame) -> DataFrame:
    return clipped.agg(F.count("*").alias("n_fields_in_envelope"))


# -- matching ----------------------------------------------------------------

def match_count(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count("*").alias("matched_fields"))


def match_reconciliation(matched: DataFrame) -> DataFrame:
    return matched.agg(
        F.count("*").alias("matched_fields"),
        F.count_if("by_primary").alias("by_single_parcel_rule"),
        F.count_if(F.col("by_aggregate") & ~F.col("by_primary")).alias("by_aggregate_rule_only"),
        F.count_if(F.col("by_primary") & F.col("by_aggregate")).alias("by_both_rules"),
        F.round(F.min("max_single_frac"), 3).alias("min_single_frac"),
        F.round(F.avg("max_single_frac"), 3).alias("avg_single_frac"),
        F.round(F.avg("union_frac"), 3).alias("avg_union_frac"),
        F.round(F.sum("field_area_ha"), 1).alias("matched_field_ha"),
    )


def parcels_with_most_fields(enriched: DataFrame, k: int = 10) -> DataFrame:
    return enriched.select("cod_imovel", "n_fields").orderBy(F.desc("n_fields"), "cod_imovel").limit(k)


def per_parcel(enriched: DataFrame) -> DataFrame:
    return enriched.select(
        "cod_imovel", "municipio", F.round("num_area", 1).alias("car_area_ha"),
        "n_fields", "matched_field_ha", "post2020_loss_ha", "n_fields_post2020_loss",
        F.when(F.col("deforestation_free"), "deforestation-free").otherwise("post-2020 loss").alias("eudr_flag"),
        F.col("ind_status").alias("car_status"),
    ).orderBy(F.desc("post2020_loss_ha"), F.desc("matched_field_ha"))


def _percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * F.try_divide(part, whole), 1)


def list_overview(matched: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row for the portfolio: field facts and parcel facts side by side, as scalar subqueries."""
    loss, ha = F.col("has_post2020_loss"), F.col("field_area_ha")
    kind = F.coalesce(F.col("geometry.kind"), F.lit(""))
    fields = matched.agg(
        F.struct(
            F.count("*").alias("n_fields"),
            F.round(F.sum(ha), 1).alias("matched_field_ha"),
            F.round(F.sum("post2020_loss_ha"), 1).alias("post2020_loss_ha"),
            F.count_if(loss).alias("fields_with_post2020_loss"),
            _percent(F.count_if(loss), F.count("*")).alias("pct_fields_post2020_loss"),
            _percent(F.sum(F.when(~loss, ha)), F.sum(ha)).alias("deforestation_free_area_pct"),
            _percent(F.count_if(kind.contains("POLYGON")), F.count("*")).alias("geoloc_polygon_pct"),
        ).alias("f")
    )
    lossy = ~F.col("deforestation_free")
    parcels = enriched.agg(
        F.struct(
            F.count("*").alias("n_parcels"),
            F.count_if(lossy).alias("parcels_with_loss"),
            _percent(F.count_if(lossy), F.count("*")).alias("pct_parcels_with_loss"),
            _percent(F.count_if(F.col("ind_status") == "AT"), F.count("*")).alias("pct_parcels_active_car"),
            _percent(F.count_if(F.col("num_area") > 4), F.count("*")).alias("pct_parcels_over_4ha"),
            F.count_if(F.col("num_area") < 1).alias("n_parcels_under_1ha"),
        ).alias("c")
    )
    row = matched.sparkSession.range(1).select(fields.scalar().alias("f"), parcels.scalar().alias("c"))
    return row.select(
        "c.n_parcels", "f.n_fields", "f.matched_field_ha", "f.deforestation_free_area_pct", "f.post2020_loss_ha",
        "f.fields_with_post2020_loss", "f.pct_fields_post2020_loss", "c.parcels_with_loss",
        "c.pct_parcels_with_loss", "f.geoloc_polygon_pct", "c.pct_parcels_over_4ha", "c.n_parcels_under_1ha",
        "c.pct_parcels_active_car",
    )


# -- loss by crop, era and parcel ---------------------------------------------

def classes_present(matched: DataFrame, scope: DataFrame) -> DataFrame:
    present = matched.select(F.col("mbmode24").cast("int").alias("mbmode24"), "mb_class").distinct()
    return scoped(present, scope, "left").select(
        "mbmode24",
        F.coalesce("policy_class", "mb_class").alias("mb_class"),
        F.coalesce("annex1_commodity", F.lit("")).alias("annex1_commodity"),
        F.coalesce("in_scope", F.lit(False)).alias("in_scope"),
        F.coalesce("caveat", F.lit("")).alias("caveat"),
    ).orderBy("mbmode24")


def _count_and_loss() -> list[Column]:
    return [F.count("*").alias("n_fields"), F.round(F.sum("post2020_loss_ha"), 1).alias("post2020_loss_ha")]


def loss_by_commodity(matched: DataFrame, scope: DataFrame) -> DataFrame:
    return in_scope(matched, scope).groupBy("annex1_commodity").agg(*_count_and_loss()).orderBy(
        F.desc("post2020_loss_ha"), "annex1_commodity"
    )


def loss_excluded(matched: DataFrame, scope: DataFrame) -> DataFrame:
    outside = scoped(matched, scope, "left").filter(~F.coalesce("in_scope", F.lit(False)))
    label = F.coalesce("policy_class", "mb_class").alias("mb_class")
    return outside.groupBy(label).agg(*_count_and_loss()).orderBy(F.desc("post2020_loss_ha"), "mb_class")


def area_by_commodity(matched: DataFrame, scope: DataFrame) -> DataFrame:
    ha = F.col("field_area_ha")
    return in_scope(matched, scope).groupBy("annex1_commodity").agg(
        F.round(F.sum(ha), 1).alias("total_ha"),
        F.round(F.try_divide(F.sum(F.when(F.col("has_post2020_loss"), ha)), F.sum(ha)), 4).alias("loss_share"),
    ).orderBy("annex1_commodity")


def worst_parcels(matched: DataFrame, enriched: DataFrame, scope: DataFrame, k: int = 10) -> DataFrame:
    total = F.col("total")
    losses = in_scope(matched, scope).groupBy("cod_imovel").agg(
        F.sum("post2020_loss_ha").alias("total"),
        F.count_if("has_post2020_loss").alias("n_fields_post2020_loss"),
    ).filter(total > 0)
    places = enriched.select("cod_imovel", "municipio").distinct()
    ordered = losses.join(places, "cod_imovel").orderBy(F.round(total, 9).desc(), "cod_imovel").limit(k)
    return ordered.select("cod_imovel", "municipio", F.round(total, 1).alias("post2020_loss_ha"),
                          "n_fields_post2020_loss")


def worst_plots(matched: DataFrame, scope: DataFrame, k: int = 10) -> DataFrame:
    lossy = in_scope(matched, scope).filter("has_post2020_loss")
    return lossy.orderBy(F.desc("post2020_loss_ha"), "Id").limit(k).select(
        F.col("Id").alias("field_id"), "cod_imovel", "annex1_commodity",
        F.round("field_area_ha", 1).alias("field_area_ha"),
        F.round("post2020_loss_ha", 1).alias("post2020_loss_ha"),
    )


def loss_by_era(matched: DataFrame) -> DataFrame:
    """All eras in one scan, then turned from columns to rows."""
    sums = matched.agg(*[F.sum(c).alias(name) for c, name in ERAS])
    total = sum((F.coalesce(F.col(f"`{name}`"), F.lit(0.0)) for _, name in ERAS[1:]),
                F.coalesce(F.col(f"`{ERAS[0][1]}`"), F.lit(0.0)))
    tall = sums.withColumn("total", total).unpivot(["total"], [f"`{name}`" for _, name in ERAS], "era", "area")
    return tall.select(
        "era",
        F.round(F.col("area") / 10000, 1).alias("cleared_ha"),
        F.round(F.try_divide(100.0 * F.col("area"), F.col("total")), 1).alias("pct_of_loss"),
    ).orderBy("era")


def loss_year_histogram(matched: DataFrame) -> DataFrame:
    lost = matched.filter((F.col("cleared_share") > 0) & F.col("mode_year").isNotNull())
    return lost.groupBy(F.col("mode_year").cast("int").alias("loss_year")).agg(
        F.count("*").alias("n_fields"), F.round(F.sum("band_loss_area") / 10000, 1).alias("cleared_ha")
    ).orderBy("loss_year")


def crop_breakdown(matched: DataFrame) -> DataFrame:
    grouped = matched.groupBy("mb_class").agg(
        F.count("*").alias("n_fields"),
        F.round(F.sum("field_area_ha"), 1).alias("total_ha"),
        F.round(F.avg("cleared_share"), 3).alias("avg_cleared_share"),
    )
    return grouped.withColumn("pct_fields", F.round(share_of_total(grouped, "n_fields"), 1)).orderBy(F.desc("n_fields"))


def legality_status(enriched: DataFrame) -> DataFrame:
    grouped = enriched.groupBy("ind_status").agg(
        F.count("*").alias("n_parcels"), F.round(F.sum("num_area"), 1).alias("total_car_ha")
    )
    labels = F.create_map(*[F.lit(v) for kv in STATUS_LABELS.items() for v in kv])
    return grouped.withColumns(
        {
            "status_label": F.coalesce(F.try_element_at(labels, F.col("ind_status")), F.col("ind_status")),
            "pct_parcels": F.round(share_of_total(grouped, "n_parcels"), 1),
        }
    ).orderBy(F.desc("n_parcels"))


# -- contacts ------------------------------------------------------------------

def _tier_list(tiers: str) -> Column:
    return F.nullif(F.array_join(F.array_sort(F.collect_set(tiers)), "|"), F.lit(""))


def coverage(matched: DataFrame, scope: DataFrame, routing: DataFrame) -> DataFrame:
    """Which delivery tiers exist for each commodity present. Groups are sets of policy tiers."""
    present = in_scope(matched, scope).select(
        "annex1_commodity", F.col("mbmode24").cast("int").alias("mbmode24")
    ).distinct()
    return present.join(F.broadcast(routing), "mbmode24", "left").groupBy("annex1_commodity").agg(
        F.coalesce(_tier_list("tier"), F.lit("no_tier")).alias("tier"),
        F.when(F.count("tier") > 0, "covered").otherwise("none").alias("coverage"),
    ).orderBy("annex1_commodity")


def routing_of_flagged(matched: DataFrame, enriched: DataFrame, scope: DataFrame, routing: DataFrame) -> DataFrame:
    routes = routing.groupBy(F.col("mbmode24").alias("_class")).agg(_tier_list("tier").alias("tiers"))
    known = scope.select(F.col("mbmode24").alias("_class"), "annex1_commodity", F.lit(True).alias("known"))
    policy = known.join(routes, "_class", "full")
    crops = enriched.select("cod_imovel", F.col("dominant_mb").cast("int").alias("dominant_mb")).distinct()
    return (
        crops.join(flagged(matched, scope), "cod_imovel", "left_semi")
        .join(F.broadcast(policy), F.col("dominant_mb") == F.col("_class"), "left")
        .select(
            "cod_imovel", "dominant_mb",
            F.coalesce("annex1_commodity", F.lit("")).alias("annex1_commodity"),
            F.coalesce("tiers", F.when(F.col("known"), "no_tier").otherwise("unknown")).alias("routed_tier"),
        )
        .orderBy("cod_imovel")
    )


def nearest_delivery(candidates: DataFrame, flags: DataFrame) -> DataFrame:
    points = candidates.filter(F.col("tier").isin(DELIVERY_TIERS)).drop("rank").join(flags, "cod_imovel", "left_semi")
    first = top_per_group(points, ["cod_imovel"], [F.col("distance_km").asc_nulls_last(), F.col("entity_id")])
    return first.select(
        "cod_imovel", "entity_id", "tier", F.round("distance_km", 1).alias("distance_km")
    ).orderBy("cod_imovel")


def membership_of_flagged(candidates: DataFrame, flags: DataFrame) -> DataFrame:
    return candidates.filter(F.col("tier") == MEMBERSHIP).join(flags, "cod_imovel", "left_semi").select(
        "cod_imovel", "entity_id", F.round("evidence_value", 1).alias("evidence")
    ).orderBy("cod_imovel")


def candidate_reconciliation(ids: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counts and flags per parcel id; an id without candidates keeps its row, and an id
    given several times counts its candidates once per copy."""
    delivered = F.coalesce(F.col("tier").isin(DELIVERY_TIERS), F.lit(False))
    flags = F.coalesce("flags", F.lit(""))
    per_id = candidates.groupBy("cod_imovel").agg(
        F.count("*").alias("n_candidates"),
        F.count_if(F.col("tier") == MEMBERSHIP).alias("n_relationship"),
        F.count_if(delivered).alias("n_delivery"),
        F.max(flags.contains("widened").cast("int")).alias("widened"),
        F.max(flags.contains("nearest_by_far").cast("int")).alias("proximity_override"),
    )
    zero = F.lit(0)
    copies = ids.groupBy("cod_imovel").agg(F.count("*").alias("_copies"))
    return copies.join(per_id, "cod_imovel", "left").select(
        "cod_imovel",
        *[
            (F.coalesce(c, zero) * F.col("_copies")).alias(c)
            for c in ("n_candidates", "n_relationship", "n_delivery")
        ],
        F.coalesce("widened", zero).alias("widened"),
        (F.coalesce("n_delivery", zero) == 0).cast("int").alias("no_match"),
        F.coalesce("proximity_override", zero).alias("proximity_override"),
    ).orderBy(F.desc("n_candidates"), "cod_imovel")


def candidate_summary(ids: DataFrame, candidates: DataFrame) -> DataFrame:
    per = candidate_reconciliation(ids, candidates)
    return per.agg(
        F.sum("widened").alias("n_widened"),
        F.sum("no_match").alias("n_no_match"),
        F.sum("proximity_override").alias("n_nearest_by_far"),
    )


def candidate_list(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "cod_imovel", "rank", "entity_id", "entity_kind", "tier", "basis",
        F.round("distance_km", 1).alias("distance_km"), F.round("evidence_value", 1).alias("evidence"), "flags",
    ).orderBy("cod_imovel", "rank")


def portfolio(matched: DataFrame, enriched: DataFrame, candidates: DataFrame, scope: DataFrame) -> DataFrame:
    """Flagged parcels with their loss, crop and first contact."""
    losses = in_scope(matched, scope).filter("has_post2020_loss").groupBy("cod_imovel").agg(
        F.round(F.sum("post2020_loss_ha"), 1).alias("post2020_loss_ha")
    )
    crops = enriched.select("cod_imovel", F.col("dominant_mb").cast("int").alias("_class"))
    policy = scope.select(F.col("mbmode24").alias("_class"), "annex1_commodity")
    top = candidates.filter(F.col("rank") == 1).select(
        "cod_imovel", "entity_id", "entity_kind", "tier", "basis", "distance_km"
    )
    blank = F.lit("")
    return (
        losses.join(crops, "cod_imovel", "left")
        .join(F.broadcast(policy), "_class", "left")
        .join(top, "cod_imovel", "left")
        .select(
            "cod_imovel",
            F.coalesce("annex1_commodity", blank).alias("annex1_commodity"),
            "post2020_loss_ha",
            F.coalesce("entity_id", blank).alias("entity_id"),
            F.coalesce("entity_kind", blank).alias("entity_kind"),
            F.coalesce("tier", F.lit("no_tier")).alias("tier"),
            F.coalesce("basis", blank).alias("basis"),
            F.round("distance_km", 1).alias("distance_km"),
        )
        .orderBy(F.desc("post2020_loss_ha"), "cod_imovel")
    )


def workflow_artifact(portfolio_rows: DataFrame) -> DataFrame:
    return portfolio_rows.withColumnRenamed("entity_id", "top_contact_entity_id")
