"""Ranked contacts per parcel: membership by municipality, delivery by distance, modelled catchments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.functions import geometry as G
from landledger.functions.projection import polyconic
from landledger.plans.skew import HOT_ROWS, split_join, top_per_group
from landledger.plans.spatial import box_pairs
from landledger.plans.stages import Stages
from landledger.policy import CATCHMENT, DELIVERY_TIERS, INTAKE, MEMBERSHIP, MILL, ROUTED_TIERS, SLAUGHTER, Policy

COLUMNS = [
    "cod_imovel", "cod_ibge", "entity_id", "entity_kind", "tier", "basis", "evidence_value", "distance_km", "flags",
]


def cadasters(parcels: DataFrame) -> DataFrame:
    """What matching needs of an enriched parcel."""
    return parcels.select(
        "cod_imovel",
        F.split_part("cod_imovel", F.lit("-"), F.lit(2)).alias("cod_ibge"),
        "dominant_mb", "cx", "cy",
    )


def on_polyconic_grid(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Add x_km and y_km, the position on the metric grid distances are measured on."""
    east, north = polyconic(F.col(lon), F.col(lat))
    return df.withColumns({"x_km": east / 1000.0, "y_km": north / 1000.0})


def membership(cad: DataFrame, facilities: DataFrame, hot_rows: int = HOT_ROWS, per_place: int | None = None) -> DataFrame:
    """Cooperatives of the parcel's own municipality.

    ``per_place`` keeps the first so many of each municipality by evidence and entity id, for callers that rank and cut a
    parcel's rows by these anyway: every pair of a municipality is formed otherwise.
    """
    coops = facilities.filter(F.col("tier") == MEMBERSHIP).withColumn("cod_ibge", F.col("entity_id"))
    if per_place is not None:
        coops = top_per_group(coops, ["cod_ibge"], [F.col("weight").desc_nulls_last(), F.col("entity_id")], per_place, "_nth")
    joined = split_join(
        cad.select("cod_imovel", "cod_ibge"),
        coops.select("cod_ibge", "entity_id", "entity_kind", "tier", "basis", "weight"),
        ["cod_ibge"], "cod_imovel", "entity_id", hot_rows,
    )
    return joined.withColumns(
        {"evidence_value": F.col("weight"), "distance_km": F.lit(None).cast("double"), "flags": F.lit("")}
    ).select(*COLUMNS)


def _near(cad: DataFrame, points: DataFrame, radius: float, hot_rows: int) -> DataFrame:
    """Pairs within ``radius`` km: cells one radius wide, each parcel looked up in its own cell
    and the eight around it. Exact, because a partner within the radius is never further away."""
    cell_x, cell_y = F.floor(F.col("x_km") / radius), F.floor(F.col("y_km") / radius)
    here = cad.withColumns({"_cx": cell_x, "_cy": cell_y})
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    there = (
        points.withColumn("_cx", F.explode(F.transform(around, lambda d: cell_x + d)))
        .withColumn("_cy", F.explode(F.transform(around, lambda d: cell_y + d)))
        .withColumnsRenamed({"x_km": "_fx", "y_km": "_fy"})
    )
    paired = split_join(here, there, ["_cx", "_cy"], "cod_imovel", "entity_id", hot_rows)
    dx, dy = F.col("x_km") - F.col("_fx"), F.col("y_km") - F.col("_fy")
    return (
        paired.withColumn("distance_km", F.sqrt(dx * dx + dy * dy))
        .filter(F.col("distance_km") <= radius)
        .drop("_cx", "_cy", "_fx", "_fy", "x_km", "y_km")
    )


def delivery(
    cad: DataFrame, facilities: DataFrame, policy: Policy, stages: Stages, hot_rows: int = HOT_ROWS,
    per_tier: int | None = None,
) -> DataFrame:
    """Delivery points within each parcel's radius, which widens until min_candidates are met.

    ``per_tier`` keeps the nearest so many of each tier and parcel, for callers that rank and cut them anyway:
    pairs beyond are dropped before they are shuffled or written. It is at least min_candidates, so the
    radius, which counts all tiers, is the same.

    The radius is the distance of the min_candidates-th nearest point held between intake_km and
    the ceiling. A parcel with enough points inside intake_km never needs the wide search, so the
    ceiling-sized join runs only for the parcels left short by the narrow one.
    """
    points = facilities.filter(F.col("tier").isin(DELIVERY_TIERS)).filter(
        (F.col("tier") != INTAKE) | (F.col("weight") >= policy.min_capacity_t)
    ).select("entity_id", "entity_kind", "tier", "basis", F.col("weight").alias("evidence_value"), "x_km", "y_km")
    spots = cad.select("cod_imovel", "cod_ibge", "x_km", "y_km")

    def near(parcels: DataFrame, radius: float) -> DataFrame:
        pairs = _near(parcels, points, radius, hot_rows)
        if per_tier is None:
            return pairs
        order = [F.col("distance_km"), F.col("evidence_value").desc_nulls_last(), F.col("entity_id")]
        return top_per_group(pairs, ["cod_imovel", "tier"], order, max(per_tier, policy.min_candidates), "_nth").drop("_nth")

    close = stages.keep("delivery_close", near(spots, policy.intake_km))
    served = (
        close.groupBy("cod_imovel").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= policy.min_candidates).select("cod_imovel")
    )
    short = spots.join(served, "cod_imovel", "left_anti")
    wide = stages.keep("delivery_wide", near(short, policy.intake_km_ceiling))
    ranked = top_per_group(
        wide.select("cod_imovel", "entity_id", "distance_km"), ["cod_imovel"],
        [F.col("distance_km"), F.col("entity_id")], policy.min_candidates, "rn",
    )
    ceiling = F.lit(policy.intake_km_ceiling)
    radius = ranked.groupBy("cod_imovel").agg(
        F.least(
            ceiling,
            F.greatest(
                F.lit(policy.intake_km),
                F.coalesce(F.max(F.when(F.col("rn") == policy.min_candidates, F.col("distance_km"))), ceiling),
            ),
        ).alias("radius_km")
    )
    widened = wide.join(radius, "cod_imovel").filter(F.col("distance_km") <= F.col("radius_km"))
    regular = close.join(served, "cod_imovel", "left_semi").withColumn("radius_km", F.lit(policy.intake_km))
    flags = F.concat_ws(
        " ",
        F.when(F.col("radius_km") > policy.intake_km, "widened"),
        F.when((F.col("tier") != MILL) & (F.col("distance_km") < policy.proximity_override_km), "nearest_by_far"),
        F.when(F.col("tier") == MILL, "town_centroid"),
    )
    return regular.unionByName(widened).withColumn("flags", flags).select(*COLUMNS, "radius_km")


def catchments(cad: DataFrame, areas: DataFrame, cell: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Modelled tier: the parcel's centroid lies inside a catchment polygon.

    ``areas`` are the catchment facilities with with_shape columns.
    """
    at = cad.select(
        "cod_imovel", "cod_ibge",
        F.col("cx").alias("xmin"), F.col("cy").alias("ymin"), F.col("cx").alias("xmax"), F.col("cy").alias("ymax"),
    ).withColumn("spot", F.struct("cod_imovel", "xmin", "ymin"))
    zones = areas.filter(F.col("tier") == CATCHMENT)
    pairs = box_pairs(
        at, zones, "spot", "entity_id", cell, hot_rows=hot_rows,
        carry_left=["cod_imovel", "cod_ibge"],
        carry_right=["entity_kind", "tier", "basis", "weight", "is_box", "edges"],
    )
    x, y = F.col("l_xmin"), F.col("l_ymin")
    strict = (x > F.col("r_xmin")) & (x < F.col("r_xmax")) & (y > F.col("r_ymin")) & (y < F.col("r_ymax"))
    inside = strict & (F.col("r_is_box") | G.contains_point(F.col("r_edges"), x, y))
    return pairs.filter(inside).select(
        F.col("l_cod_imovel").alias("cod_imovel"), F.col("l_cod_ibge").alias("cod_ibge"),
        F.col("r_entity_id").alias("entity_id"), F.col("r_entity_kind").alias("entity_kind"),
        F.col("r_tier").alias("tier"), F.col("r_basis").alias("basis"), F.col("r_weight").alias("evidence_value"),
        F.lit(None).cast("double").alias("distance_km"), F.lit("").alias("flags"),
    )


def class_tiers(scope: DataFrame, routing: DataFrame) -> DataFrame:
    """(class, tier) a class of known policy keeps; the catchment rides along with the silo."""
    routed = routing.select("mbmode24", "tier")
    rides = routing.filter(F.col("tier") == INTAKE).select("mbmode24", F.lit(CATCHMENT).alias("tier"))
    known = scope.select("mbmode24")
    return routed.unionByName(rides).distinct().join(known, "mbmode24", "left_semi")


def allowed_tiers(cad: DataFrame, scope: DataFrame, routing: DataFrame) -> DataFrame:
    """(parcel id, tier) that survive routing. A class without policy keeps every tier."""
    crop = F.col("dominant_mb").cast("int")
    known = F.broadcast(scope.select(F.col("mbmode24").alias("_class")))
    unknown = cad.withColumn("_class", crop).join(known, "_class", "left_anti")
    every = unknown.select("cod_imovel", F.explode(F.array(*[F.lit(t) for t in ROUTED_TIERS])).alias("tier"))
    tiers = F.broadcast(class_tiers(scope, routing).withColumnRenamed("mbmode24", "_class"))
    routed = cad.withColumn("_class", crop).join(tiers, "_class").select("cod_imovel", "tier")
    return every.unionByName(routed).distinct()


def apply_routing(candidates: DataFrame, allowed: DataFrame) -> DataFrame:
    """Membership is never routed away; delivery and catchment rows need an allowed tier."""
    free = candidates.filter(~F.col("tier").isin(ROUTED_TIERS))
    bound = candidates.filter(F.col("tier").isin(ROUTED_TIERS)).join(allowed, ["cod_imovel", "tier"], "left_semi")
    return free.unionByName(bound.select(*free.columns))


def rank_candidates(candidates: DataFrame, policy: Policy) -> DataFrame:
    """The first max_candidates per parcel: overrides, tier order, distance, evidence, entity id."""
    tier = F.col("tier")
    order = (
        F.when(F.col("flags").contains("nearest_by_far"), 0)
        .when(tier == MEMBERSHIP, 1)
        .when(tier.isin(INTAKE, SLAUGHTER), 2)
        .when(tier == MILL, 3)
        .when(tier == CATCHMENT, 4)
        .otherwise(5)
    )
    return top_per_group(
        candidates.select(*COLUMNS), ["cod_imovel"],
        [order, F.col("distance_km").asc_nulls_last(), F.col("evidence_value").desc_nulls_last(), F.col("entity_id")],
        policy.max_candidates,
    )


def match_candidates(
    cad: DataFrame, facilities: DataFrame, scope: DataFrame, routing: DataFrame,
    policy: Policy, stages: Stages, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``cad``: cadasters with x_km, y_km. ``facilities``: with_shape columns and x_km, y_km."""
    every = (
        membership(cad, facilities, hot_rows, policy.max_candidates)
        .unionByName(delivery(cad, facilities, policy, stages, hot_rows, policy.max_candidates).drop("radius_km"))
        .unionByName(catchments(cad, facilities, policy.cell, hot_rows))
    )
    every = stages.keep("every_candidate", every)
    return rank_candidates(apply_routing(every, allowed_tiers(cad, scope, routing)), policy)
