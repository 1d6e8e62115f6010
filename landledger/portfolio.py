"""The staged analysis over the derived tables: parcels, list, fields, matching, contacts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger import derive
from landledger.operators import candidates as C
from landledger.operators import match as M
from landledger.operators import resolve as R
from landledger.operators.rollups import flagged
from landledger.plans.stages import Stages
from landledger.policy import routing_table, scope_table


class Portfolio:
    """Every stage is built at most once per application, input and policy."""

    def __init__(self, spark: SparkSession, sf_dir: str, policy=derive.PLANE):
        self.spark, self.sf_dir, self.policy = spark, sf_dir, policy
        self.stages = Stages.of(spark, sf_dir, policy)

    @property
    def scope(self) -> DataFrame:
        return scope_table(self.spark)

    @property
    def routing(self) -> DataFrame:
        return routing_table(self.spark)

    @property
    def parcels(self) -> DataFrame:
        return self.stages.table("parcels", lambda: derive.parcels(self.spark, self.sf_dir))

    @property
    def facilities(self) -> DataFrame:
        return self.stages.table("facilities", lambda: derive.facilities(self.spark, self.sf_dir))

    @cached_property
    def resolution(self) -> R.Resolution:
        listed = self.stages.table("list", lambda: derive.dirty_list(self.spark, self.sf_dir, self.parcels))
        prepared = self.stages.table("prepared", lambda: R.prepare(listed, self.policy))
        return R.resolve(prepared, self.parcels, self.policy, self.stages)

    @property
    def resolved(self) -> DataFrame:
        return self.stages.table("resolved", lambda: self.resolution.resolved)

    @property
    def cad(self) -> DataFrame:
        return self.stages.table("cad", lambda: R.listed_parcels(self.resolution, self.parcels))

    @property
    def raw_fields(self) -> DataFrame:
        return self.stages.table("raw_fields", lambda: derive.fields(self.spark, self.sf_dir))

    @property
    def fields(self) -> DataFrame:
        """On the plane one square unit counts as one hectare."""
        return self.stages.table(
            "fields", lambda: M.enrich_fields(M.clip_to_envelope(self.raw_fields, self.cad), F.col("area"))
        )

    @property
    def overlaps(self) -> DataFrame:
        return self.stages.table("overlaps", lambda: M.overlaps(self.fields, self.cad, self.policy))

    @property
    def union(self) -> DataFrame:
        return self.stages.table("union", lambda: M.union_fraction(self.fields, self.cad, self.policy, self.stages))

    @property
    def decision(self) -> DataFrame:
        return self.stages.table(
            "decision", lambda: M.decide(self.fields, M.primary_parcel(self.overlaps, self.policy), self.union, self.policy)
        )

    @property
    def matched(self) -> DataFrame:
        """Without the shapes: of these, the views read only the kind."""
        facts = self.fields.withColumn("geometry", F.struct(F.col("geometry.kind").alias("kind"))).drop("edges", "is_box")
        return self.stages.table("matched", lambda: M.admitted(self.decision, facts))

    @property
    def enriched(self) -> DataFrame:
        return self.stages.table("enriched", lambda: M.enrich_parcels(self.cad, self.matched).drop("geometry", "edges", "is_box"))

    @property
    def cadasters(self) -> DataFrame:
        return self.stages.table(
            "cadasters", lambda: C.cadasters(self.enriched).withColumns({"x_km": F.col("cx"), "y_km": F.col("cy")})
        )

    @property
    def candidates(self) -> DataFrame:
        return self.stages.table(
            "candidates",
            lambda: C.match_candidates(
                self.cadasters, self.facilities, self.scope, self.routing, self.policy, self.stages
            ),
        )

    @property
    def flagged(self) -> DataFrame:
        return flagged(self.matched, self.scope)
