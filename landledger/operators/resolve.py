"""List resolution: every row of a messy property list lands in exactly one bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.functions import geometry as G
from landledger.functions.sweep import overlap_area
from landledger.plans.skew import top_per_group
from landledger.plans.spatial import box_pairs, pair_area
from landledger.plans.stages import Stages
from landledger.policy import Policy

BUCKETS = [
    "resolved_clean",
    "centroid_resolved",
    "geometry_resolved",
    "axis_repaired",
    "duplicates_removed",
    "unresolvable",
]


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col.cast("string")), F.lit(""))


def prepare(listed: DataFrame, policy: Policy) -> DataFrame:
    """Parse, repair swapped axes, and mark repeats of (id, geometry) after the first.

    ``listed`` has row_id, raw_id, raw_wkt. The first of each set of copies is found by
    an aggregate over the copies and joined back on row_id, so copies never share a task.
    """
    parsed = listed.select(
        "row_id",
        blank_to_null(F.col("raw_id")).alias("raw_id"),
        blank_to_null(F.col("raw_wkt")).alias("raw_wkt"),
        G.from_wkt(blank_to_null(F.col("raw_wkt"))).alias("as_given"),
    ).withColumn("_edges", G.edges(F.col("as_given")))
    here = G.meets_box(F.col("_edges"), policy.study_box)
    swapped = G.meets_box(F.col("_edges"), policy.study_box, swap=True)
    prepared = parsed.withColumn("axis_flipped", F.coalesce(~here & swapped, F.lit(False))).select(
        "row_id",
        "raw_id",
        "axis_flipped",
        F.when(F.col("axis_flipped"), G.flip(F.col("as_given"))).otherwise(F.col("as_given")).alias("geometry"),
        "raw_wkt",
    )
    # text that is no shape here is compared as it stands
    shape = F.when(F.col("geometry.rings").isNotNull(), F.to_json("geometry")).otherwise(F.col("raw_wkt"))
    prepared = prepared.withColumn(
        "_copy", F.sha2(F.concat_ws("|", F.coalesce("raw_id", F.lit("")), F.coalesce(shape, F.lit(""))), 256)
    ).drop("raw_wkt")
    kept = prepared.groupBy("_copy").agg(F.min("row_id").alias("row_id")).select("row_id", F.lit(True).alias("_first"))
    return (
        prepared.join(kept, "row_id", "left")
        .withColumn("duplicate", F.col("_first").isNull())
        .drop("_copy", "_first")
    )


def in_listed_states(parcels: DataFrame, prepared: DataFrame) -> DataFrame:
    """Parcels of the states the list's ids name."""
    states = (
        prepared.filter(F.col("raw_id").isNotNull())
        .select(F.split_part("raw_id", F.lit("-"), F.lit(1)).alias("cod_estado"))
        .distinct()
    )
    return parcels.join(states, "cod_estado", "left_semi")


def touching(shapes: DataFrame, parcels: DataFrame, policy: Policy) -> DataFrame:
    """Pairs (row_id, parcel) of id-less shapes and the parcels they meet, with the shared area.

    Both sides carry with_shape columns; parcels carry row_key and cod_imovel.
    """
    carried = ["area", "is_box", "edges"]
    pairs = box_pairs(
        shapes, parcels, "row_id", "row_key", policy.cell,
        carry_left=["kind", *carried], carry_right=["cod_imovel", *carried],
    )
    is_point = F.col("l_kind") == "POINT"
    # A point is contained strictly inside; touching decides only which parcels are read at all.
    within = F.when(
        F.col("r_is_box"),
        (F.col("l_xmin") > F.col("r_xmin")) & (F.col("l_xmin") < F.col("r_xmax"))
        & (F.col("l_ymin") > F.col("r_ymin")) & (F.col("l_ymin") < F.col("r_ymax")),
    ).otherwise(G.contains_point(F.col("r_edges"), F.col("l_xmin"), F.col("l_ymin")))
    pairs = pairs.withColumn("shared", pair_area(pairs, overlap_area)).withColumn("contains", is_point & within)
    return pairs.filter(F.col("shared").isNotNull() | F.col("contains")).select(
        F.col("l_row_id").alias("row_id"), F.col("l_kind").alias("kind"), F.col("l_area").alias("own_area"),
        F.col("r_row_key").alias("row_key"), F.col("r_cod_imovel").alias("cod_imovel"), "shared", "contains",
    )


@dataclass
class Resolution:
    prepared: DataFrame
    hits: DataFrame
    resolved: DataFrame


def resolve(prepared: DataFrame, parcels: DataFrame, policy: Policy, stages: Stages) -> Resolution:
    """``parcels`` carry row_key, cod_imovel, cod_estado and with_shape columns.

    ``prepared`` and ``parcels`` are stage tables; the shapes still open and their hits become two more.
    """
    open_rows = prepared.filter(~F.col("duplicate") & F.col("raw_id").isNull() & F.col("geometry").isNotNull())
    shapes = stages.table(
        "open_shapes", lambda: G.with_shape(open_rows).withColumn("kind", F.col("geometry.kind"))
    )
    hits = stages.table("hits", lambda: touching(shapes, in_listed_states(parcels, prepared), policy))

    point_hits = (
        hits.filter(F.col("contains"))
        .groupBy("row_id")
        .agg(F.count("*").alias("n_parcels"), F.min("cod_imovel").alias("point_id"))
    )
    fractions = (
        hits.filter(F.col("kind") != "POINT")
        .withColumn("frac", F.col("shared") / F.nullif(F.col("own_area"), F.lit(0.0)))
        .filter(F.col("frac") >= policy.contain_threshold)
    )
    best = top_per_group(fractions, ["row_id"], [F.col("frac").desc(), F.col("cod_imovel")])
    polygon_hits = best.select("row_id", F.col("cod_imovel").alias("polygon_id"))

    sole = point_hits.filter(F.col("n_parcels") == 1).select("row_id", F.col("point_id"))
    found = F.coalesce("polygon_id", "point_id")
    bucket = (
        F.when(F.col("duplicate"), "duplicates_removed")
        .when(F.col("raw_id").isNotNull(), "resolved_clean")
        .when(found.isNull(), "unresolvable")
        .when(F.col("axis_flipped"), "axis_repaired")
        .when(F.col("point_id").isNotNull(), "centroid_resolved")
        .otherwise("geometry_resolved")
    )
    resolved = (
        prepared.join(polygon_hits, "row_id", "left")
        .join(sole, "row_id", "left")
        .select("row_id", F.coalesce(F.col("raw_id"), found).alias("cod_imovel"), bucket.alias("resolution"))
    )
    return Resolution(prepared, hits, resolved)


def listed_parcels(outcome: Resolution, parcels: DataFrame) -> DataFrame:
    """The parcel rows behind the resolved ids.

    A parcel is read when the list names its id or when it meets an id-less shape.
    The two key sets are unioned: an OR of the two tests would defeat the equi joins.
    """
    in_states = in_listed_states(parcels, outcome.prepared)
    named = outcome.prepared.filter(F.col("raw_id").isNotNull()).select(F.col("raw_id").alias("cod_imovel")).distinct()
    by_id = in_states.join(named, "cod_imovel", "left_semi").select("row_key")
    wanted = by_id.unionByName(outcome.hits.select("row_key")).distinct()
    ids = outcome.resolved.filter(F.col("cod_imovel").isNotNull()).select("cod_imovel").distinct()
    return in_states.join(wanted, "row_key", "left_semi").join(ids, "cod_imovel", "left_semi")


def reconciliation(resolved: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("resolution") == b).alias(b) for b in BUCKETS]
    return resolved.agg(
        F.count("*").alias("input_rows"), *counts, F.count_distinct("cod_imovel").alias("resolved_parcels")
    )


def resolution_counts(resolved: DataFrame, cad: DataFrame) -> DataFrame:
    """Distinct ids asked for, found, and missing."""
    wanted = resolved.filter(F.col("cod_imovel").isNotNull()).select("cod_imovel").distinct()
    found = cad.select("cod_imovel", F.lit(1).alias("found")).distinct()
    one = wanted.withColumn("listed", F.lit(1)).join(found, "cod_imovel", "full")
    return one.agg(
        F.count("listed").alias("list_ids"),
        F.count("found").alias("found_in_car"),
        (F.count("listed") - F.count("found")).alias("missing"),
    )


def municipality_counts(cad: DataFrame) -> DataFrame:
    return cad.select("cod_imovel", "municipio").distinct().groupBy("municipio").agg(
        F.count("*").alias("n_parcels")
    ).orderBy(F.desc("n_parcels"), "municipio")


def quality_counts(cad: DataFrame) -> DataFrame:
    """Ids carried by several parcels, and distinct parcels under one hectare."""
    per_id = cad.groupBy("cod_imovel").agg(
        (F.count("*") > 1).cast("int").alias("repeated"),
        F.count_distinct(F.when(F.col("num_area") < 1, F.col("num_area"))).alias("small"),
    )
    return per_id.agg(
        F.coalesce(F.sum("repeated"), F.lit(0)).alias("n_duplicate_ids"),
        F.coalesce(F.sum("small"), F.lit(0)).alias("n_parcels_under_1ha"),
    )
