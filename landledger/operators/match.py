"""Field to parcel matching by shared area, and the rollups built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.functions import geometry as G
from landledger.functions.geometry import all_edges, own_edges
from landledger.functions.projection import spheroid_area_m2
from landledger.functions.sweep import overlap_area, union_area, union_region
from landledger.plans.skew import HOT_ROWS, attach, top_per_group
from landledger.plans.spatial import BOUNDS, box_pairs, pair_area
from landledger.plans.stages import Stages
from landledger.policy import ERAS, FIELD_LABELS, Policy
from landledger.session import kernel_partitions

# Pieces handled by one kernel call. More pieces are merged chunk by chunk first.
FAN_IN = 64


def spheroid_hectares(geom: Column) -> Column:
    return F.round(spheroid_area_m2(geom) / 10000.0, 4)


def enrich_fields(fields: DataFrame, hectares: Column) -> DataFrame:
    """Readable label, total loss, cleared share, worst era and loss after the cut-off."""
    bands = [F.coalesce(F.col(c), F.lit(0.0)) for c, _ in ERAS]
    total = sum(bands[1:], bands[0])
    code = F.col("mbmode24").cast("int")
    labels = F.create_map(*[F.lit(v) for kv in FIELD_LABELS.items() for v in kv])
    # The last era wins a tie: compare (loss, position).
    worst = F.array_max(F.array(*[F.struct(b.alias("loss"), F.lit(i).alias("era")) for i, b in enumerate(bands)]))
    era_names = F.array(*[F.lit(name) for _, name in ERAS])
    return fields.withColumn("field_area_ha", hectares).withColumns(
        {
            "mb_class": F.coalesce(F.try_element_at(labels, code), F.concat(F.lit("Class "), code.cast("string"))),
            "band_loss_area": total,
            "cleared_share": F.when(
                F.col("field_area_ha") > 0, F.least(total / (F.col("field_area_ha") * 10000), F.lit(1.0))
            ).otherwise(0.0),
            "defor_era": F.when(worst["loss"] == 0, "None").otherwise(F.element_at(era_names, worst["era"] + 1)),
            "post2020_loss_ha": F.round(bands[-1] / 10000.0, 4),
            "has_post2020_loss": bands[-1] > 0,
        }
    )


def clip_to_envelope(fields: DataFrame, cad: DataFrame) -> DataFrame:
    """Fields whose shape meets the bounding box of the listed parcels.

    The box is one row by construction; its four numbers enter the filter as scalar subqueries.
    """
    frame = cad.agg(
        F.struct(
            F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"),
            F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        )
    ).scalar()
    framed = fields.withColumn("_frame", frame)
    xmin, ymin, xmax, ymax = (F.col(f"_frame.{c}") for c in ("xmin", "ymin", "xmax", "ymax"))
    meets = (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin)
    inside = (F.col("xmin") >= xmin) & (F.col("xmax") <= xmax) & (F.col("ymin") >= ymin) & (F.col("ymax") <= ymax)
    # Only a shape across the rim of the frame needs the exact test.
    return framed.filter(meets & (inside | F.col("is_box") | G.meets_box(F.col("edges"), (xmin, ymin, xmax, ymax)))).drop(
        "_frame"
    )


def overlaps(fields: DataFrame, cad: DataFrame, policy: Policy, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(field_id, cod_imovel, inter_area, field_area) for every touching pair; touching counts as area 0."""
    shape = ["area", "is_box", "edges"]
    pairs = box_pairs(
        fields, cad, "Id", "row_key", policy.cell, hot_rows=hot_rows,
        carry_left=shape, carry_right=["cod_imovel", *shape],
    )
    return (
        pairs.withColumn("inter_area", pair_area(pairs, overlap_area))
        .filter(F.col("inter_area").isNotNull())
        .select(
            F.col("l_Id").alias("field_id"), F.col("r_cod_imovel").alias("cod_imovel"),
            "inter_area", F.col("l_area").alias("field_area"),
        )
    )


def primary_parcel(ov: DataFrame, policy: Policy, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Best containment fraction per field, and the lowest id within the tie tolerance of it."""
    scored = ov.withColumn("frac", F.col("inter_area") / F.nullif(F.col("field_area"), F.lit(0.0)))
    # Rows of the same id need not be brought together first: the best and the lowest id are the same with them.
    topped = attach(scored.select("field_id", "cod_imovel", "frac"), ["field_id"], {"best": F.max("frac")}, ["cod_imovel"], hot_rows)
    tied = F.coalesce(F.col("best") - F.col("frac") <= policy.primary_tie_tolerance, F.lit(True))
    return topped.filter(tied).groupBy("field_id").agg(
        F.max("best").alias("max_single_frac"), F.min("cod_imovel").alias("primary_cod_imovel")
    )


def union_fraction(
    fields: DataFrame, cad: DataFrame, policy: Policy, stages: Stages, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Share of each field inside the union of all listed parcels, widened by the neighbour gap.

    No global union is built: area(f ∩ ∪ all) = area(f ∩ ∪ near f). Copies of a parcel
    count once. Fields with one plain piece, or a piece covering them, need no kernel.
    """
    gap = policy.gap
    # A shape's copies, told by the first half of a SHA-256, are one row before any pair is formed; edges join only what needs
    # the kernel. The written table gives each shape a number, which is shorter than the digest in the shuffles that follow.
    copy = F.unhex(F.substring(F.sha2(F.to_json("edges"), 256), 1, 32))
    distinct = cad.select(copy.alias("_digest"), *BOUNDS, "is_box", "edges").dropDuplicates(["_digest"]).drop("_digest")
    shapes = stages.keep("union_shapes", distinct.select(F.monotonically_increasing_id().alias("_copy"), "*"))
    pairs = box_pairs(
        fields, shapes, "Id", "_copy", policy.cell, reach=gap, hot_rows=hot_rows,
        carry_left=["area", "is_box"], carry_right=["is_box"],
    )
    width = F.least("l_xmax", "r_xmax") - F.greatest("l_xmin", "r_xmin")
    height = F.least("l_ymax", "r_ymax") - F.greatest("l_ymin", "r_ymin")
    pieces = pairs.select(
        F.col("l_Id").alias("Id"),
        F.col("r__copy").alias("_copy"),
        F.col("l_area").alias("field_area"),
        F.col("l_is_box").alias("field_is_box"),
        # the field's box lies inside a box-shaped parcel
        (
            F.col("r_is_box")
            & (F.col("r_xmin") <= F.col("l_xmin")) & (F.col("r_xmax") >= F.col("l_xmax"))
            & (F.col("r_ymin") <= F.col("l_ymin")) & (F.col("r_ymax") >= F.col("l_ymax"))
        ).alias("covers"),
        F.when(F.lit(gap == 0) & F.col("r_is_box"), F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0)))
        .alias("box_shared"),
    )
    if gap == 0:
        # A box that shares no interior adds no area.
        pieces = pieces.filter(F.col("box_shared").isNull() | (F.col("box_shared") > 0))
    pieces = stages.keep("union_pieces", pieces)
    told = attach(
        pieces, ["Id"],
        {"pieces": F.count("*"), "covered": F.bool_or("covers")},
        ["_copy"], hot_rows,
    )
    told = stages.keep("union_pieces_told", told)
    whole = told.filter("covered").groupBy("Id").agg(F.max("field_area").alias("shared"), F.max("field_area").alias("field_area"))
    partial = told.filter("NOT covered")
    simple = (F.col("pieces") == 1) & F.col("box_shared").isNotNull() & F.col("field_is_box")
    single = partial.filter(simple).select("Id", F.col("box_shared").alias("shared"), "field_area")
    parts = [whole, single]

    # Chunk number: hash modulo the number of chunks. Chunks of a field with many pieces are
    # merged into regions, sixty-four at a time, until one is left.
    most = told.agg(F.coalesce(F.max("pieces"), F.lit(0))).first()[0]
    def slim() -> list[Column]:
        return [*[F.col(b) for b in BOUNDS], own_edges(F.col("is_box"), F.col("edges")).alias("edges")]

    def whole_edges(at: Column) -> Column:
        return all_edges(at["edges"], *[at[b] for b in BOUNDS])

    chunks = (
        partial.filter(~simple).select("Id", "_copy", "pieces", "field_area")
        .join(fields.select("Id", F.struct(*slim()).alias("_field")), "Id")
        .join(shapes.select("_copy", F.struct(*slim()).alias("_piece")), "_copy")
        .withColumn("_chunks", F.ceil(F.col("pieces") / FAN_IN))
        .withColumn("_chunk", F.pmod(F.xxhash64("_copy"), F.col("_chunks")))
        .repartition(kernel_partitions(fields.sparkSession), "Id", "_chunk")
        .groupBy("Id", "_chunk", "_chunks")
        .agg(F.collect_list("_piece").alias("pieces"), F.first("_field").alias("_field"), F.first("field_area").alias("field_area"))
    )
    groups = chunks.select(
        "Id", "_chunk", "_chunks", "field_area",
        F.transform("pieces", whole_edges).alias("pieces"), whole_edges(F.col("_field")).alias("field_edges"),
    )
    widen = gap
    while True:
        parts.append(
            groups.filter(F.col("_chunks") == 1).select("Id", union_area(widen)("field_edges", "pieces").alias("shared"), "field_area")
        )
        if most <= FAN_IN:
            break
        merged = groups.filter(F.col("_chunks") > 1).select(
            "Id", "field_edges", "field_area", union_region(widen)("field_edges", "pieces").alias("piece"),
            F.floor(F.col("_chunk") / FAN_IN).alias("_chunk"), F.ceil(F.col("_chunks") / FAN_IN).alias("_chunks"),
        )
        groups = merged.groupBy("Id", "_chunk", "_chunks").agg(
            F.collect_list("piece").alias("pieces"), F.first("field_edges").alias("field_edges"), F.first("field_area").alias("field_area")
        )
        most, widen = -(-most // FAN_IN), 0.0
    shared = parts[0]
    for part in parts[1:]:
        shared = shared.unionByName(part)
    return shared.select(
        F.col("Id").alias("field_id"),
        (F.col("shared") / F.nullif(F.col("field_area"), F.lit(0.0))).alias("union_frac"),
    )


def decide(fields: DataFrame, single: DataFrame, union: DataFrame, policy: Policy) -> DataFrame:
    """One row per field with both fractions, unrounded, and which of the two tests it passes."""
    return (
        fields.select(F.col("Id").alias("field_id"))
        .join(single, "field_id", "left")
        .join(union, "field_id", "left")
        .select(
            "field_id",
            F.coalesce("max_single_frac", F.lit(0.0)).alias("max_single_frac"),
            F.coalesce("union_frac", F.lit(0.0)).alias("union_frac"),
            "primary_cod_imovel",
        )
        .withColumn("by_primary", F.col("max_single_frac") >= policy.contain_threshold)
        .withColumn("by_aggregate", F.col("union_frac") >= policy.contain_threshold)
    )


def admitted(decision: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields passing either test, with their primary parcel and the audit trail."""
    passed = decision.filter(
        (F.col("by_primary") | F.col("by_aggregate")) & F.col("primary_cod_imovel").isNotNull()
    ).select(
        F.col("field_id").alias("Id"), F.col("primary_cod_imovel").alias("cod_imovel"),
        "max_single_frac", "union_frac", "by_primary", "by_aggregate",
    )
    return passed.join(fields, "Id")


def match_fields(
    fields: DataFrame, cad: DataFrame, policy: Policy, stages: Stages, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The decision per field from its best single parcel and the union of all.

    Both inputs carry with_shape columns, fields an Id, parcels row_key and cod_imovel.
    They are read several times, so pass stage tables.
    """
    ov = stages.keep("overlaps", overlaps(fields, cad, policy, hot_rows))
    union = stages.keep("union", union_fraction(fields, cad, policy, stages, hot_rows))
    return decide(fields, primary_parcel(ov, policy, hot_rows), union, policy)


def excluded_count(decision: DataFrame) -> DataFrame:
    """Fields that share area with a parcel and pass neither test."""
    return decision.filter(
        (F.coalesce("max_single_frac", F.lit(0.0)) > 0) & ~F.col("by_primary") & ~F.col("by_aggregate")
    ).agg(F.count("*").alias("n_excluded"))


def dominant_class(matched: DataFrame) -> DataFrame:
    """Class with the most hectares per parcel id; equal hectares go to the lower code."""
    per_class = (
        matched.filter(F.col("mbmode24").isNotNull())
        .groupBy("cod_imovel", "mbmode24")
        .agg(F.sum("field_area_ha").alias("class_ha"))
    )
    picked = top_per_group(per_class, ["cod_imovel"], [F.col("class_ha").desc(), F.col("mbmode24")])
    return picked.select("cod_imovel", F.col("mbmode24").alias("dominant_mb"))


def enrich_parcels(cad: DataFrame, matched: DataFrame) -> DataFrame:
    """Per-parcel rollup. Fields are summed per id before the join, so no group is keyed by shape."""
    per_id = matched.groupBy("cod_imovel").agg(
        F.count("Id").alias("n_fields"),
        F.sum("field_area_ha").alias("_ha"),
        F.sum("post2020_loss_ha").alias("_loss"),
        F.count_if("has_post2020_loss").alias("_lossy"),
    )
    zero = F.lit(0.0)
    # the centroid is taken before the joins, so that a caller who drops the shape moves none
    return (
        cad.withColumns(G.centroid(F.col("geometry"))).join(per_id, "cod_imovel", "left")
        .join(dominant_class(matched), "cod_imovel", "left")
        .withColumns(
            {
                "n_fields": F.coalesce("n_fields", F.lit(0)),
                "matched_field_ha": F.round(F.coalesce("_ha", zero), 1),
                "post2020_loss_ha": F.round(F.coalesce("_loss", zero), 2),
                "n_fields_post2020_loss": F.coalesce("_lossy", F.lit(0)),
                "deforestation_free": F.coalesce("_loss", zero) == 0,
            }
        )
        .drop("_ha", "_loss", "_lossy")
    )
