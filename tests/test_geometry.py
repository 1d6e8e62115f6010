import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landledger.functions import geometry as G
from landledger.functions.projection import polyconic, spheroid_area_m2
from landledger.functions import sweep
from landledger.functions.sweep import _closed, cover, cushion, touches
from landledger.functions.wkb import from_wkb, to_wkb


def rect(x, y, x2, y2):
    return _closed(np.array([[x, y], [x2, y], [x2, y2], [x, y2]], dtype=float))


def random_star(rng, cx, cy, n=9):
    angles = np.sort(rng.uniform(0, 2 * np.pi, n))
    radius = rng.uniform(1, 4, n)
    return _closed(np.column_stack([cx + radius * np.cos(angles), cy + radius * np.sin(angles)]))


def inside(edges, px, py):
    x1, y1, x2, y2 = (v[:, None] for v in edges.T)
    spans = (y1 > py) != (y2 > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = px < (x2 - x1) * (py - y1) / (y2 - y1) + x1
    return (spans & cross).sum(axis=0) % 2 == 1


def test_union_of_rectangles_counts_the_overlap_once():
    field = rect(0, 0, 10, 10)
    assert cover(field, [rect(-1, -1, 6, 11), rect(4, -1, 11, 11)]) == pytest.approx(100)
    assert cover(field, [rect(0, 0, 5, 5), rect(2, 2, 7, 7)]) == pytest.approx(25 + 25 - 9)
    assert cover(field, [rect(20, 20, 30, 30)]) == 0.0
    assert cover(field, [rect(10, 0, 20, 10)]) == 0.0


def test_general_polygons_agree_with_sampling():
    rng = np.random.default_rng(7)
    for _ in range(5):
        field = random_star(rng, 0, 0)
        pieces = [random_star(rng, *rng.uniform(-3, 3, 2)) for _ in range(4)]
        px, py = rng.uniform(-4, 4, (2, 200_000))
        hit = inside(field, px, py) & np.any([inside(p, px, py) for p in pieces], axis=0)
        assert cover(field, pieces) == pytest.approx(64 * hit.mean(), abs=0.25)


def test_holes_and_region_merge():
    holed = np.vstack([rect(0, 0, 10, 10), rect(4, 4, 6, 6)])
    assert cover(rect(0, 0, 10, 10), [holed]) == pytest.approx(96)
    rng = np.random.default_rng(3)
    field = random_star(rng, 0, 0, 12)
    pieces = [random_star(rng, *rng.uniform(-3, 3, 2)) for _ in range(10)]
    merged = [cover(field, pieces[:5], as_region=True), cover(field, pieces[5:], as_region=True)]
    assert cover(field, merged) == pytest.approx(cover(field, pieces), rel=1e-9)


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_many_fields_are_swept_together_with_the_areas_each_has_alone(monkeypatch, block):
    monkeypatch.setattr(sweep, "PAIR_BLOCK", block)
    rng = np.random.default_rng(5)
    fields = [random_star(rng, 1000, -5, n) for n in rng.integers(3, 12, 200)]
    pieces = [[random_star(rng, *rng.uniform(-6, 6, 2) + [1000, -5], n) for n in rng.integers(3, 9, k)] for k in rng.integers(0, 6, 200)]
    whole = [[np.round(p) for p in many] for many in pieces]  # shared corners and edges
    for given in (pieces, whole):
        want = [cover(f, many) for f, many in zip(fields, given)]
        flat = pa.array([[p.ravel() for p in many] for many in given], pa.list_(pa.list_(pa.float64())))
        calls = []
        with monkeypatch.context() as patched:
            patched.setattr(sweep, "cover", lambda *a: calls.append(a) or cover(*a))
            at = flat.offsets.to_numpy()
            got = sweep.cover_many(sweep._lists(pa.array([f.ravel() for f in fields])), sweep._lists(flat.values), at[:-1], at[1:])
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert sum(w > 0 for w in want) > 50 and (block < 1 << 20 or not calls)


def test_precision_far_from_the_origin():
    shift = np.tile([-51.25, -15.75], 2)
    a, b = rect(0, 0, 0.01, 0.01), rect(0.005, 0, 0.02, 0.01)
    near = cover(a, [b]) / 1e-4
    far = cover(a + shift, [b + shift]) / 1e-4
    assert abs(near - far) < 1e-10


def test_cushion_widens_a_square_by_strips_and_rounded_corners():
    wide = cushion(rect(0, 0, 10, 10), 1.0)
    corner = 32 / 2 * math.sin(2 * math.pi / 32)
    assert cover(rect(-5, -5, 15, 15), wide) == pytest.approx(100 + 40 + corner, rel=1e-9)
    assert cover(rect(10.2, 2, 10.7, 4), wide) == pytest.approx(1.0)


def test_touching():
    assert touches(rect(0, 0, 1, 1), rect(1, 0, 2, 1))
    assert touches(rect(0, 0, 10, 10), rect(4, 4, 5, 5))
    assert not touches(rect(0, 0, 1, 1), rect(1.001, 0, 2, 1))


def test_many_pairs_are_tested_for_touching_together():
    rng = np.random.default_rng(2)
    left = [np.round(random_star(rng, 1000, -5, n)) for n in rng.integers(3, 9, 500)]
    right = [np.round(random_star(rng, *rng.uniform(-7, 7, 2) + [1000, -5], n)) for n in rng.integers(3, 9, 500)]
    want = [touches(a, b) for a, b in zip(left, right)]
    columns = [sweep._lists(pa.array([e.ravel() for e in side])) for side in (left, right)]
    assert sweep.touches_many(*columns, np.arange(500)).tolist() == want and 50 < sum(want) < 450
    assert sweep.touches_many(*columns, np.arange(3, 500, 7)).tolist() == want[3::7]


def test_overlapping_shapes_are_derived_once(spark, monkeypatch):
    from landledger import catalog

    made = []
    monkeypatch.setattr(catalog, "Stages", type("Told", (catalog.Stages,), {"_open": {}, "table": lambda self, name, build: made.append(name) or catalog.Stages.__mro__[1].table(self, name, build)}))
    plan = catalog.polygon_overlap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert made == ["patches", "outlines"] and "part.parquet" not in plan and "REPARTITION" not in plan.upper()


WKT = [
    ("POINT (-50.5 -15.25)", 0.0, -50.5, -15.25),
    ("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))", 8.0, 2.0, 1.0),
    ("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))", 96.0, (500 - 12) / 96, (500 - 12) / 96),
    ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((10 0, 13 0, 13 1, 10 1, 10 0)))", 4.0, (0.5 + 34.5) / 4, 0.5),
]


def test_wkt_wkb_and_measures(spark):
    df = spark.createDataFrame([(w,) for w, *_ in WKT], "wkt string").withColumn("g", G.from_wkt(F.col("wkt")))
    c = G.centroid(F.col("g"))
    out = df.select(
        "wkt", G.area(F.col("g")).alias("a"), c["cx"].alias("cx"), c["cy"].alias("cy"),
        G.to_wkt(F.col("g")).alias("again"),
        (F.to_json(from_wkb(to_wkb(F.col("g")))) == F.to_json("g")).alias("same"),
        G.to_wkt(G.flip(G.flip(F.col("g")))).alias("twice"),
    ).collect()
    for row, (wkt, area, cx, cy) in zip(out, WKT):
        assert row.a == pytest.approx(area) and row.cx == pytest.approx(cx) and row.cy == pytest.approx(cy)
        assert row.same and row.again == row.twice
        assert row.again.replace(".0", "") == wkt


def test_point_tests(spark):
    shape = "POLYGON ((0 0, 10 0, 10 10, 5 5, 0 10, 0 0))"
    points = [(5.0, 2.0, True), (5.0, 7.0, False), (0.0, 5.0, False), (5.0, 5.0, False), (1.0, 8.0, True), (11.0, 1.0, False)]
    df = spark.createDataFrame(points, "x double, y double, want boolean").withColumn(
        "e", G.edges(G.from_wkt(F.lit(shape)))
    )
    for row in df.select("want", G.contains_point(F.col("e"), F.col("x"), F.col("y")).alias("got")).collect():
        assert row.got == row.want
    boxes = [((4.5, 6.0, 5.5, 9.0), False), ((4.0, 4.0, 6.0, 9.0), True), ((10.0, 0.0, 12.0, 1.0), True), ((1.0, 1.0, 2.0, 2.0), True)]
    for frame, want in boxes:
        assert df.limit(1).select(G.meets_box(F.col("e"), frame)).first()[0] == want


def test_polyconic_and_spheroid(spark):
    one = spark.range(1)
    a, b = polyconic(F.lit(-51.0), F.lit(-15.8)), polyconic(F.lit(-50.0), F.lit(-15.8))
    km = one.select(F.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) / 1000).first()[0]
    assert km == pytest.approx(107.14, abs=0.05)
    assert one.select(*polyconic(F.lit(-54.0), F.lit(0.0))).first()[:] == (5_000_000.0, 10_000_000.0)
    cell = G.from_wkt(F.lit("POLYGON ((-50 -16, -49 -16, -49 -15, -50 -15, -50 -16))"))
    e2 = 0.00669438002290
    e = math.sqrt(e2)

    def q(lat):
        s = math.sin(math.radians(lat))
        return s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e)

    want = (1 - e2) * 6378137.0**2 / 2 * math.radians(1) * abs(q(-15) - q(-16))
    assert one.select(spheroid_area_m2(cell)).first()[0] == pytest.approx(want, rel=1e-9)


def test_text_that_is_no_shape_gives_no_rings(spark):
    texts = ["POINT EMPTY", "POINT (1)", "POINT ()", "POLYGON EMPTY", "POLYGON ((0 0, 1 x, 1 1, 0 0))", "LINESTRING (1 1, 2 2)", "MULTIPOINT (1 1)", "nonsense", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(G.from_wkt(F.col("t")).alias("g"))
    assert rows.filter("g.rings is not null").count() == 0
    rows.select(*[c.alias(n) for n, c in G.bounds(F.col("g")).items()], G.edges(F.col("g")), G.to_wkt(F.col("g"))).collect()
    raised = spark.createDataFrame([("POINT Z (1 2 3)",)], "t string").select(G.to_wkt(G.from_wkt(F.col("t"))).alias("w"))
    assert raised.first().w == "POINT (1.0 2.0)"
