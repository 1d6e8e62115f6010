"""Turning clean parcels into a list with known defects, for exercising list resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.functions import geometry as G

# Fixed value: a point inside the country's box that lies in no parcel.
UNRESOLVABLE_POINT = "POINT (-35 -10)"
# The columns of the list.
LIST_COLUMNS = ["cod_imovel", "municipio", "cod_estado", "geometry"]


def inject(parcels: DataFrame, donors: dict[str, str]) -> DataFrame:
    """The list made from ``parcels``: donors replaced by their damaged form, two rows appended.

    donors maps "duplicate", "centroid", "geometry" and "axis_flip" to parcel ids. Extra columns:
    parcel_geometry (what the geometry encoding carries), defect, resolves_to.
    """
    by_id = {v: k for k, v in donors.items() if k != "duplicate"}
    defect = F.lit("")
    for parcel_id, name in by_id.items():
        defect = F.when(F.col("cod_imovel") == parcel_id, name).otherwise(defect)
    parcels = parcels.withColumnRenamed("geometry", "_shape")
    shape, center = F.col("_shape"), G.centroid(F.col("_shape"))
    damaged: Column = (
        F.when(F.col("defect") == "centroid", G.to_wkt(G.point(center["cx"], center["cy"])))
        .when(F.col("defect") == "geometry", G.to_wkt(shape))
        .when(F.col("defect") == "axis_flip", G.to_wkt(G.flip(shape)))
    )
    hurt = F.col("defect") != ""

    def blank(name: str) -> Column:
        return F.when(hurt, "").otherwise(F.col(name)).alias(name)

    base = parcels.withColumn("defect", defect)
    rows = base.select(
        blank("cod_imovel"), blank("municipio"), blank("cod_estado"),
        F.coalesce(damaged, F.lit("")).alias("geometry"),
        F.coalesce(damaged, G.to_wkt(shape)).alias("parcel_geometry"),
        "defect", F.col("cod_imovel").alias("resolves_to"),
    )
    copy = parcels.filter(F.col("cod_imovel") == donors["duplicate"]).select(
        "cod_imovel", "municipio", "cod_estado", F.lit("").alias("geometry"),
        G.to_wkt(shape).alias("parcel_geometry"), F.lit("duplicate").alias("defect"),
        F.col("cod_imovel").alias("resolves_to"),
    )
    stray = parcels.sparkSession.range(1).select(
        F.lit("").alias("cod_imovel"), F.lit("").alias("municipio"), F.lit("").alias("cod_estado"),
        F.lit(UNRESOLVABLE_POINT).alias("geometry"), F.lit(UNRESOLVABLE_POINT).alias("parcel_geometry"),
        F.lit("unresolvable").alias("defect"), F.lit("").alias("resolves_to"),
    )
    return rows.unionByName(copy).unionByName(stray)
