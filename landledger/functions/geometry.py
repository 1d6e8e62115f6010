"""Planar geometry as column expressions.

A geometry is ``struct<kind, rings array<struct<hole, pts array<struct<x, y>>>>>``
with x the longitude. Inside tests use the even-odd rule over all rings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructType

_POINT_TYPE = StructType().add("x", DoubleType()).add("y", DoubleType())
_RING_TYPE = StructType().add("hole", BooleanType()).add("pts", ArrayType(_POINT_TYPE))
GEOMETRY_TYPE = StructType().add("kind", StringType()).add("rings", ArrayType(_RING_TYPE))

_NUMBER_LIST = r"\(([^()]+)\)"
_POLYGON_BODY = r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)"


def _simple(kind: str, corners: list[tuple[Column, Column]]) -> Column:
    pts = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])
    ring = F.struct(F.lit(False).alias("hole"), pts.alias("pts"))
    shape = F.struct(F.lit(kind).alias("kind"), F.array(ring).alias("rings"))
    # Through a lambda, so the optimizer computes the struct once instead of copying its
    # construction into every expression that reads a field of it.
    return F.element_at(F.transform(F.array(shape), lambda s: s), 1)


def point(x: Column, y: Column) -> Column:
    return _simple("POINT", [(x, y)])


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return _simple("POLYGON", [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)])


def from_wkt(wkt: Column) -> Column:
    """POINT, POLYGON and MULTIPOLYGON text; anything else, empty shapes and broken numbers give null rings.

    Coordinates past the second are dropped.
    """

    def to_point(text: Column) -> Column:
        parts = F.split(F.trim(text, F.lit(" \t\r\n")), r"\s+")
        return F.struct(
            F.get(parts, 0).try_cast("double").alias("x"),
            F.get(parts, 1).try_cast("double").alias("y"),
        )

    def to_pts(body: Column) -> Column:
        return F.transform(F.split(body, ","), to_point)

    kind = F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))
    point_ring = F.array(
        F.struct(F.lit(False).alias("hole"), to_pts(F.regexp_extract(wkt, _NUMBER_LIST, 1)).alias("pts"))
    )
    polygons = F.regexp_extract_all(wkt, F.lit(_POLYGON_BODY), F.lit(1))
    polygon_rings = F.flatten(
        F.transform(
            polygons,
            lambda body: F.transform(
                F.regexp_extract_all(body, F.lit(_NUMBER_LIST), F.lit(1)),
                lambda ring, i: F.struct((i > 0).alias("hole"), to_pts(ring).alias("pts")),
            ),
        )
    )
    rings = F.when(kind == "POINT", point_ring).when(kind.isin("POLYGON", "MULTIPOLYGON"), polygon_rings)
    # through a lambda, so that the parsed rings are made once
    def checked(found: Column) -> Column:
        whole = (F.size(found) > 0) & F.forall(found, lambda r: F.forall(r["pts"], lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
        return F.struct(kind.alias("kind"), F.when(whole, found).alias("rings"))

    return F.when(wkt.isNotNull(), F.element_at(F.transform(F.array(rings), checked), 1))


def to_wkt(geom: Column) -> Column:
    """Text form; the outer ring of each polygon starts a new polygon part."""

    def ring_text(ring: Column) -> Column:
        coords = F.transform(ring["pts"], lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
        return F.concat(F.lit("("), F.array_join(coords, ", "), F.lit(")"))

    body = F.aggregate(
        geom["rings"],
        F.lit(""),
        lambda acc, ring: F.concat(
            acc,
            F.when(acc == "", F.lit("("))
            .when(ring["hole"], F.lit(", "))
            .otherwise(F.lit("), (")),
            ring_text(ring),
        ),
    )
    return (
        F.when(geom["kind"] == "POINT", F.concat(F.lit("POINT "), ring_text(geom["rings"][0])))
        .when(geom["kind"] == "POLYGON", F.concat(F.lit("POLYGON "), body, F.lit(")")))
        .when(geom["kind"] == "MULTIPOLYGON", F.concat(F.lit("MULTIPOLYGON ("), body, F.lit("))")))
    )


def flip(geom: Column) -> Column:
    """Exchange longitude and latitude."""
    rings = F.transform(
        geom["rings"],
        lambda r: F.struct(
            r["hole"].alias("hole"),
            F.transform(r["pts"], lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y"))).alias("pts"),
        ),
    )
    return F.when(geom.isNotNull(), F.struct(geom["kind"].alias("kind"), rings.alias("rings")))


def bounds(geom: Column) -> dict[str, Column]:
    pts = F.flatten(F.transform(geom["rings"], lambda r: r["pts"]))
    xs = F.transform(pts, lambda p: p["x"])
    ys = F.transform(pts, lambda p: p["y"])
    return {
        "xmin": F.array_min(xs),
        "ymin": F.array_min(ys),
        "xmax": F.array_max(xs),
        "ymax": F.array_max(ys),
    }


def _ring_sums(pts: Column, term) -> Column:
    """Sum of ``term(a, b)`` over the edges, coordinates taken from the first vertex."""
    origin = pts[0]

    def local(p: Column) -> tuple[Column, Column]:
        return p["x"] - origin["x"], p["y"] - origin["y"]

    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(pts) - 1, F.lit(1))),
        F.lit(0.0),
        lambda acc, i: acc + F.coalesce(term(local(F.get(pts, i - 1)), local(F.get(pts, i))), F.lit(0.0)),
    )


def _cross(a, b) -> Column:
    return a[0] * b[1] - b[0] * a[1]


def area(geom: Column) -> Column:
    """Planar area: outer rings minus holes."""
    return F.aggregate(
        geom["rings"],
        F.lit(0.0),
        lambda acc, r: acc + F.when(r["hole"], -1.0).otherwise(1.0) * F.abs(_ring_sums(r["pts"], _cross)) / 2,
    )


def centroid(geom: Column, size: Column | None = None) -> dict[str, Column]:
    """Area-weighted centroid; a point is its own centroid. ``size`` is the area where it is known."""
    first = geom["rings"][0]["pts"][0]

    def weighted(axis: int) -> Column:
        def ring(acc: Column, r: Column) -> Column:
            pts = r["pts"]
            signed = _ring_sums(pts, _cross) / 2
            moment = _ring_sums(pts, lambda a, b: (a[axis] + b[axis]) * _cross(a, b)) / 6
            offset = pts[0]["x" if axis == 0 else "y"] - first["x" if axis == 0 else "y"]
            sign = F.when(r["hole"], -1.0).otherwise(1.0) * F.signum(signed)
            return acc + sign * (moment + offset * signed)

        return F.aggregate(geom["rings"], F.lit(0.0), ring)

    size = area(geom) if size is None else size
    return {
        "cx": F.when(size > 0, first["x"] + weighted(0) / size).otherwise(first["x"]),
        "cy": F.when(size > 0, first["y"] + weighted(1) / size).otherwise(first["y"]),
    }


def edges(geom: Column) -> Column:
    """Flat ``x1, y1, x2, y2`` list of every edge, the form the Arrow kernels take."""
    return F.flatten(
        F.flatten(
            F.transform(
                geom["rings"],
                lambda r: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size(r["pts"]) - 1, F.lit(1))),
                    lambda i: F.array(
                        F.get(r["pts"], i - 1)["x"],
                        F.get(r["pts"], i - 1)["y"],
                        F.coalesce(F.get(r["pts"], i)["x"], F.get(r["pts"], i - 1)["x"]),
                        F.coalesce(F.get(r["pts"], i)["y"], F.get(r["pts"], i - 1)["y"]),
                    ),
                ),
            )
        )
    )


def own_edges(is_box: Column, flat_edges: Column) -> Column:
    """The edges where bounds do not tell them: a box travels without."""
    return F.when(is_box, F.lit(None)).otherwise(flat_edges)


def all_edges(own: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The edges again, those of a box from its bounds."""
    return F.coalesce(own, F.array(xmin, ymin, xmax, ymin, xmax, ymin, xmax, ymax, xmax, ymax, xmin, ymax, xmin, ymax, xmin, ymin))


def contains_point(flat_edges: Column, x: Column, y: Column) -> Column:
    """Strict interior test by ray casting; a point on the boundary is not inside."""

    def step(acc: Column, i: Column) -> Column:
        x1, y1 = F.get(flat_edges, i * 4), F.get(flat_edges, i * 4 + 1)
        x2, y2 = F.get(flat_edges, i * 4 + 2), F.get(flat_edges, i * 4 + 3)
        turn = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        on_edge = (
            (turn == 0)
            & x.between(F.least(x1, x2), F.greatest(x1, x2))
            & y.between(F.least(y1, y2), F.greatest(y1, y2))
        )
        crosses = ((y1 > y) != (y2 > y)) & ((turn > 0) == (y2 > y1))
        return F.struct(
            (acc["inside"] != crosses).alias("inside"),
            (acc["boundary"] | on_edge).alias("boundary"),
        )

    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("boundary"))
    walked = F.aggregate(F.sequence(F.lit(0), (F.size(flat_edges) / 4).cast("int") - 1), start, step)
    return walked["inside"] & ~walked["boundary"]


def meets_box(flat_edges: Column, frame: tuple, swap: bool = False) -> Column:
    """The shape shares a point with a box (numbers or columns); ``swap`` exchanges the shape's axes."""
    xmin, ymin, xmax, ymax = map(F.lit, frame)
    xi, yi = (1, 0) if swap else (0, 1)

    def cuts(i: Column) -> Column:
        x1, y1 = F.get(flat_edges, i * 4 + xi), F.get(flat_edges, i * 4 + yi)
        x2, y2 = F.get(flat_edges, i * 4 + 2 + xi), F.get(flat_edges, i * 4 + 2 + yi)
        near = (
            (F.least(x1, x2) <= xmax) & (F.greatest(x1, x2) >= xmin)
            & (F.least(y1, y2) <= ymax) & (F.greatest(y1, y2) >= ymin)
        )
        sides = [
            F.signum((x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1))
            for cx, cy in ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax))
        ]
        # the four corners are not all strictly on one side of the edge's line
        return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    corner = (ymin, xmin) if swap else (xmin, ymin)
    count = (F.size(flat_edges) / 4).cast("int")
    return F.exists(F.sequence(F.lit(0), count - 1), cuts) | contains_point(flat_edges, *corner)


def with_shape(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """Add bounds, planar area, edge list and whether the shape is its own bounding box."""
    # The coordinate lists are columns of their own so that each is built once per row.
    pts = df.withColumn("_pts", F.flatten(F.transform(F.col(geom)["rings"], lambda r: r["pts"])))
    out = pts.withColumns(
        {"_xs": F.transform("_pts", lambda p: p["x"]), "_ys": F.transform("_pts", lambda p: p["y"])}
    ).withColumns(
        {
            "xmin": F.array_min("_xs"), "ymin": F.array_min("_ys"),
            "xmax": F.array_max("_xs"), "ymax": F.array_max("_ys"),
        }
    )
    out = out.withColumn("area", area(F.col(geom))).drop("_pts", "_xs", "_ys")
    return out.withColumns(
        {
            "is_box": (F.col("area") > 0)
            & (F.col("area") == (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))),
            "edges": edges(F.col(geom)),
        }
    )
