"""Bounding-box join on a grid: spatial predicates become equi joins on cells.

Cells come in four sizes, each sixteen times the last. A shape sits at the first
size that is at least as large as its bounding box, so it covers at most four
cells there. Two shapes meet at the coarser of their two sizes, and only the
cell holding the lower-left corner of the common box reports the pair.

A cell with too many pairs is divided: its counts say how often its sides are halved, and what is still too much for a
task afterwards, as when all shapes lie on each other, is cut into parts of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.functions.geometry import all_edges, own_edges
from landledger.plans.skew import HOT_ROWS, PAIRS, split_join

LEVELS = 4
STEP = 16


def _cell_size(level: Column, cell: float) -> Column:
    return F.lit(cell) * F.pow(F.lit(float(STEP)), level)


def _level(cell: float) -> Column:
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    out = F.lit(LEVELS - 1)
    for level in reversed(range(LEVELS - 1)):
        out = F.when(side <= cell * STEP**level, F.lit(level)).otherwise(out)
    return out


def _index(value: Column, level: Column, cell: float) -> Column:
    return F.floor(value / _cell_size(level, cell))


def _place(df: DataFrame, other: DataFrame, cell: float) -> DataFrame:
    """One row per cell of the shape's own size, and of each coarser size the other side uses."""
    used = other.select(_level(cell).alias("level")).distinct()  # at most LEVELS rows
    own = df.withColumn("_own", _level(cell))
    at = own.withColumn("level", F.explode(F.sequence(F.col("_own"), F.lit(LEVELS - 1)))).join(
        F.broadcast(used.withColumn("_used", F.lit(True))), "level", "left"
    )
    at = at.filter((F.col("level") == F.col("_own")) | F.col("_used"))
    at = at.withColumn(
        "cell_x",
        F.explode(F.sequence(_index(F.col("xmin"), F.col("level"), cell), _index(F.col("xmax"), F.col("level"), cell))),
    )
    return at.withColumn(
        "cell_y",
        F.explode(F.sequence(_index(F.col("ymin"), F.col("level"), cell), _index(F.col("ymax"), F.col("level"), cell))),
    ).drop("_used")


BOUNDS = ["xmin", "ymin", "xmax", "ymax"]
CELL = ["level", "cell_x", "cell_y"]
#: A cell's sides are halved so often at most.
DEPTH = 4


def _crowded(left: DataFrame, right: DataFrame, pairs: float) -> DataFrame:
    """Cells with more than ``pairs`` pairs, and how often to halve their sides; each halving leaves a sixteenth of evenly spread pairs.

    One side of such a cell has more rows than the root of ``pairs``, which bounds their number.
    """
    met = left.groupBy(*CELL).agg(F.count("*").cast("double").alias("_l")).join(right.groupBy(*CELL).agg(F.count("*").cast("double").alias("_r")), CELL)
    product = F.col("_l") * F.col("_r")
    halvings = F.least(F.lit(DEPTH), F.ceil(F.log(product / pairs) / F.log(F.lit(16.0)))).cast("int")
    return met.filter(product > pairs).select(*CELL, halvings.alias("_halved"))


def _divided(cells: DataFrame, crowded: DataFrame, side: str, cell: float) -> DataFrame:
    """One row per piece of a crowded cell that the shape's box touches, at (piece_x, piece_y); a cell that is not crowded is one piece."""
    at = cells.join(F.broadcast(crowded), CELL, "left").withColumn("_halved", F.coalesce("_halved", F.lit(0)))
    pieces = F.pow(F.lit(2.0), F.col("_halved")).cast("bigint")
    for axis in ("x", "y"):
        first, last = F.col(f"cell_{axis}") * pieces, (F.col(f"cell_{axis}") + 1) * pieces - 1

        def index(bound: str) -> Column:
            return F.floor(F.col(f"{side}_{axis}{bound}") / (_cell_size(F.col("level"), cell) / pieces))

        within = F.sequence(F.greatest(index("min"), first), F.least(index("max"), last))
        at = at.withColumn(f"piece_{axis}", F.explode(F.when(pieces == 1, F.array(first)).otherwise(within)))
    return at


def box_pairs(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    cell: float,
    reach: float = 0.0,
    hot_rows: int = HOT_ROWS,
    carry_left: list[str] = (),
    carry_right: list[str] = (),
) -> DataFrame:
    """Pairs whose closed boxes come within ``reach`` on each axis, each pair once.

    Result columns: ``<key>`` and ``l_*`` / ``r_*`` for bounds and carried columns.
    Only keys, bounds and the named columns travel through the shuffle.
    """
    wide = {"xmin": F.col("xmin") - reach, "ymin": F.col("ymin") - reach,
            "xmax": F.col("xmax") + reach, "ymax": F.col("ymax") + reach}
    lcols = list(dict.fromkeys([left_key, *BOUNDS, *carry_left]))
    rcols = list(dict.fromkeys([right_key, *BOUNDS, *carry_right]))
    lsrc, rsrc = left.select(*lcols), right.select(*rcols)
    # boxes travel without their edges, which their bounds tell again after the join
    lsrc, rsrc = (s.withColumn("edges", own_edges(F.col("is_box"), F.col("edges"))) if {"is_box", "edges"} <= set(s.columns) else s for s in (lsrc, rsrc))
    rsrc = rsrc.withColumns({f"_raw_{b}": F.col(b) for b in BOUNDS}).withColumns(wide)
    lcells = _place(lsrc, rsrc, cell)
    rcells = _place(rsrc, lsrc, cell)
    lcells = lcells.select(
        "level", "cell_x", "cell_y", F.col("_own").alias("_l_own"), *[F.col(c).alias(f"l_{c}") for c in lcols]
    )
    rcells = rcells.select(
        "level", "cell_x", "cell_y", F.col("_own").alias("_r_own"),
        *[F.col(c).alias(f"r_{c}") for c in rcols], *[F.col(f"_raw_{b}") for b in BOUNDS],
    )
    crowded = _crowded(lcells, rcells, float(min(PAIRS, hot_rows**2)))
    lcells = _divided(lcells, crowded, "l", cell)
    rcells = _divided(rcells, crowded, "r", cell).drop("_halved")
    hot = crowded.select(*CELL)
    joined = split_join(lcells, rcells, [*CELL, "piece_x", "piece_y"], f"l_{left_key}", f"r_{right_key}", hot_rows, among=hot)
    piece = _cell_size(F.col("level"), cell) / F.pow(F.lit(2.0), F.col("_halved"))
    corner_x = F.greatest("l_xmin", "r_xmin")
    corner_y = F.greatest("l_ymin", "r_ymin")
    met = joined.filter(
        (F.col("level") == F.greatest("_l_own", "_r_own"))
        & (F.col("l_xmin") <= F.col("r_xmax"))
        & (F.col("r_xmin") <= F.col("l_xmax"))
        & (F.col("l_ymin") <= F.col("r_ymax"))
        & (F.col("r_ymin") <= F.col("l_ymax"))
        & (F.floor(corner_x / piece) == F.col("piece_x"))
        & (F.floor(corner_y / piece) == F.col("piece_y"))
    )
    raw = {f"r_{b}": F.col(f"_raw_{b}") for b in BOUNDS}
    met = met.withColumns(raw).drop(*CELL, "piece_x", "piece_y", "_halved", "_l_own", "_r_own", *[f"_raw_{b}" for b in BOUNDS])
    for side, cols in (("l", lcols), ("r", rcols)):
        if {"is_box", "edges"} <= set(cols):
            met = met.withColumn(f"{side}_edges", all_edges(F.col(f"{side}_edges"), *[F.col(f"{side}_{b}") for b in BOUNDS]))
    return met


def pair_area(pairs: DataFrame, overlap) -> Column:
    """Shared area of the carried shapes; null where they do not even touch.

    Two boxes need no kernel. Empty lists go to Python for them, not nulls: Arrow writes
    a run of null lists in quadratic time.
    """
    nothing = F.array().cast("array<double>")
    both_box = F.col("l_is_box") & F.col("r_is_box")
    width = F.least("l_xmax", "r_xmax") - F.greatest("l_xmin", "r_xmin")
    height = F.least("l_ymax", "r_ymax") - F.greatest("l_ymin", "r_ymin")
    general = overlap(
        F.when(~both_box, F.col("l_edges")).otherwise(nothing),
        F.when(~both_box, F.col("r_edges")).otherwise(nothing),
    )
    return F.when(both_box, F.when((width >= 0) & (height >= 0), width * height)).otherwise(general)


