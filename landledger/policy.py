"""Thresholds and policy tables. Changing a rule is an edit here, not in a job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

METRES_PER_DEGREE = 111320


@dataclass(frozen=True)
class Policy:
    contain_threshold: float = 0.667
    neighbor_gap_tolerance_m: float = 25.0
    primary_tie_tolerance: float = 1e-9
    max_candidates: int = 5
    min_candidates: int = 2
    intake_km: float = 100.0
    intake_km_ceiling: float = 300.0
    proximity_override_km: float = 10.0
    min_capacity_t: float = 1000.0
    # xmin, ymin, xmax, ymax of the coarse "is this the right country" test
    study_box: tuple[float, float, float, float] = (-75.0, -34.0, -28.0, 6.0)
    # finest cell of the spatial join, in the units of the coordinates
    cell: float = 0.05

    @property
    def gap(self) -> float:
        return round(self.neighbor_gap_tolerance_m / METRES_PER_DEGREE, 8)


# Land-cover class, label, regulated commodity, in scope, caveat.
SCOPE = [
    (15, "Pasture", "cattle", True, ""),
    (39, "Soybean", "soya", True, ""),
    (35, "Palm Oil", "oil palm", True, "mixed_detection_quality"),
    (46, "Coffee", "coffee", True, "mixed_detection_quality"),
    (21, "Mosaic of Uses", "cattle", True, "assumed_pasture"),
    (9, "Forest Plantation", "wood", False, "unreliable_detection"),
    (18, "Agriculture", None, False, ""),
    (20, "Sugarcane", None, False, ""),
    (40, "Rice", None, False, ""),
    (41, "Other Temporary Crops", None, False, ""),
    (47, "Citrus", None, False, ""),
    (48, "Other Perennial", None, False, ""),
    (62, "Cotton", None, False, ""),
]

# Land-cover class to the delivery tier it may be sent to.
ROUTING = [
    (15, "slaughter_point"),
    (21, "slaughter_point"),
    (20, "mill_point"),
    (39, "intake_point"),
    (41, "intake_point"),
    (18, "intake_point"),
    (18, "mill_point"),
]

# Names of the facility tiers.
MEMBERSHIP = "membership_muni"
INTAKE, SLAUGHTER, MILL = "intake_point", "slaughter_point", "mill_point"
CATCHMENT = "gravity_catchment"
DELIVERY_TIERS = [INTAKE, SLAUGHTER, MILL]
ROUTED_TIERS = DELIVERY_TIERS + [CATCHMENT]

# Field labels used where the scope table is not joined.
FIELD_LABELS = {
    15: "Pasture",
    18: "Agriculture",
    41: "Other Temporary Crops",
    21: "Mosaic of Uses",
    39: "Soybean",
    9: "Forest Plantation",
}

# Loss-era columns, oldest first.
ERAS = [
    ("deforestarea0104", "2001-2004"),
    ("deforestarea0509", "2005-2009"),
    ("deforestarea1014", "2010-2014"),
    ("deforestarea1520", "2015-2020"),
    ("deforestarea2124", "2021-2024"),
]

# Registration status codes and their labels.
STATUS_LABELS = {
    "AT": "Active (ativo)",
    "PE": "Pending (pendente)",
    "CA": "Cancelled (cancelado)",
    "SU": "Suspended (suspenso)",
}

# List price per million tokens (input, output) and cache factors.
PRICES = {"haiku": (1.0, 5.0), "sonnet": (3.0, 15.0), "opus": (5.0, 25.0)}
CACHE_WRITE_FACTOR, CACHE_READ_FACTOR = 1.25, 0.10


def scope_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SCOPE, "mbmode24 int, mb_class string, annex1_commodity string, in_scope boolean, caveat string"
    )


def routing_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTING, "mbmode24 int, tier string")


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m, i, o) for m, (i, o) in PRICES.items()],
        "model string, input_per_mtok double, output_per_mtok double",
    )
