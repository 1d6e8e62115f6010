import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from landledger.functions import geometry as G
from landledger.functions.sweep import cover
from landledger.operators import candidates as C
from landledger.operators import defects as X
from landledger.operators import match as M
from landledger.operators import resolve as R
from landledger.operators import rollups as V
from landledger.plans import skew
from landledger.plans.spatial import box_pairs
from landledger.policy import Policy, routing_table, scope_table

POLICY = Policy()


def wkt_box(x, y, x2, y2):
    return f"POLYGON (({x} {y}, {x2} {y}, {x2} {y2}, {x} {y2}, {x} {y}))"


def shapes(spark, rows, schema):
    """Rows whose last column is WKT."""
    df = spark.createDataFrame(rows, schema + ", wkt string")
    return G.with_shape(df.withColumn("geometry", G.from_wkt(F.col("wkt"))).drop("wkt"))


def parcels_of(spark, rows):
    return shapes(spark, rows, "row_key long, cod_imovel string, cod_estado string, municipio string, num_area double")


# -- joins ----------------------------------------------------------------------

def test_box_pairs_against_brute_force(spark):
    rng = random.Random(5)

    def boxes(n, sizes):
        out = []
        for i in range(n):
            x, y, s = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice(sizes)
            out.append((i, x, y, x + s * rng.random(), y + s * rng.random()))
        return out

    left, right = boxes(120, [0.5, 3, 40, 300]), boxes(90, [1, 20, 300, 5000])
    cols = "xmin double, ymin double, xmax double, ymax double"
    l, r = spark.createDataFrame(left, "a long, " + cols), spark.createDataFrame(right, "b long, " + cols)
    want = {
        (p[0], q[0]) for p in left for q in right
        if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    }
    for hot in (10, 500_000):
        got = [tuple(x) for x in box_pairs(l, r, "a", "b", 1.0, hot_rows=hot).select("l_a", "r_b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_hot_keys_give_the_same_rows(spark):
    rows = [(i, 7 if i % 3 else i, float(i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k long, v double")
    dim = spark.createDataFrame([(k, f"n{k}{c}") for k in range(0, 600, 1) for c in "ab"], "k long, name string")
    plain = sorted(map(tuple, df.join(dim, "k").select("id", "name").collect()))
    split = sorted(map(tuple, skew.split_join(df, dim, ["k"], "id", "name", hot_rows=20).select("id", "name").collect()))
    assert plain == split
    for hot in (20, 10_000):
        told = skew.attach(df, ["k"], {"top": F.max("v"), "n": F.count("*")}, ["id"], hot).collect()
        assert len(told) == 600
        assert {(r.k, r.top, r.n) for r in told if r.k == 7} == {(7, 10.0, 400 + 0)}


def test_key_hot_on_both_sides_is_met_by_part_pairs(spark):
    left = spark.range(3_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"))
    right = spark.range(2_000).select(F.col("id").alias("name"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = skew.split_join(left, right, ["k"], "id", "name", hot_rows=300)
        per_task = joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.countDistinct("id", "name").alias("d"))
        rows = per_task.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    total = 2_700 * 1_800 + 200
    assert sum(r.n for r in rows) == sum(r.d for r in rows) == total
    assert len(rows) == 16 and max(r.n for r in rows) < total / 6  # 54 part pairs, dealt by hash
    parts = skew._parts(left, right, ["k"], 300, None).collect()
    assert [(r.k, r._lefts >= 9, r._rights >= 6) for r in parts] == [(-1, True, True)]


@pytest.mark.parametrize("spread", [0.9, 0.001, 0.0])
def test_cell_crowded_on_both_sides(spark, spread):
    """Boxes in one cell: spread over it, in a corner of it, and all in one place."""
    rng = random.Random(9)

    def boxes(n):
        corners = [(rng.random() * spread, rng.random() * spread) for _ in range(n)]
        return [(i, x, y, x + 0.02 * spread + 0.01, y + 0.02 * spread + 0.01) for i, (x, y) in enumerate(corners)]

    left, right = boxes(200), boxes(150)
    cols = "xmin double, ymin double, xmax double, ymax double"
    l, r = spark.createDataFrame(left, "a long, " + cols), spark.createDataFrame(right, "b long, " + cols)
    want = sorted((p[0], q[0]) for p in left for q in right if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    for hot in (8, 40, 500_000):
        got = sorted(map(tuple, box_pairs(l, r, "a", "b", 1.0, hot_rows=hot).select("l_a", "r_b").collect()))
        assert got == want
        near = box_pairs(l, r, "a", "b", 1.0, reach=0.05, hot_rows=hot).select("l_a", "r_b").distinct().count()
        assert near == sum(1 for p in left for q in right if p[1] <= q[3] + 0.05 and q[1] - 0.05 <= p[3] and p[2] <= q[4] + 0.05 and q[2] - 0.05 <= p[4])


def test_exact_median(spark):
    rng = random.Random(4)
    groups = {"one": [rng.gauss(0, 1e6) for _ in range(3_001)], "even": [float(rng.randint(0, 5)) for _ in range(1_000)], "hot": [7.0] * 900 + [1.0] * 901,
              "two": [1.0, 4.0], "single": [3.0], None: [2.0, 8.0, 9.0], "none": [None]}
    rows = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    want = {g: float(statistics.median(v)) for g, v in groups.items() if v != [None]}
    for buckets in (256, 3):
        told = skew.exact_median(df, ["g"], "v", "m", buckets)
        assert {r.g: r.m for r in told.collect()} == want
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "median" not in plan.lower() and "percentile(" not in plan.lower()


def test_dense_rank_matches_window(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), float(rng.choice([1, 2, 2, 5, 9]) * rng.randrange(40))) for _ in range(500)]
    df = spark.createDataFrame(rows, "run int, v double")
    got = {(r.run, r.v): r.position for r in skew.dense_rank(df, ["run"], "v", buckets=8).collect()}
    for run in range(3):
        for pos, v in enumerate(sorted({b for a, b in rows if a == run})):
            assert got[(run, v)] == pos


# -- list resolution --------------------------------------------------------------

def test_every_row_lands_in_one_bucket(spark, stages):
    land = parcels_of(spark, [
        (1, "GO-1-A", "GO", "M1", 5.0, wkt_box(-50, -16, -49.9, -15.9)),
        (2, "GO-1-B", "GO", "M1", 0.5, wkt_box(-49.95, -16, -49.85, -15.9)),
        (3, "GO-2-C", "GO", "M2", 9.0, "POLYGON ((-48 -16, -47.9 -16, -47.95 -15.9, -48 -16))"),
        (4, "MT-9-D", "MT", "M9", 9.0, wkt_box(-47.5, -16, -47.4, -15.9)),
    ])
    rows = [
        (1, " GO-1-A ", None), (2, "GO-1-A", ""), (3, "", "POINT (-49.99 -15.95)"),
        (4, None, "POINT (-49.93 -15.95)"), (5, "", "POLYGON ((-48 -16, -47.9 -16, -47.95 -15.9, -48 -16))"),
        (6, "", "POLYGON ((-16 -48, -16 -47.9, -15.9 -47.95, -16 -48))"), (7, "", "POINT (-35 -10)"),
        (8, "", "POINT (100 80)"), (9, " ", " "), (10, "", "POINT (-47.45 -15.95)"), (11, "GO-7-Z", None),
    ]
    listed = spark.createDataFrame(rows, "row_id long, raw_id string, raw_wkt string")
    prepared = stages.keep("prepared", R.prepare(listed, POLICY))
    out = R.resolve(prepared, land, POLICY, stages)
    got = {r.row_id: (r.cod_imovel, r.resolution) for r in out.resolved.collect()}
    assert got == {
        1: ("GO-1-A", "resolved_clean"), 2: ("GO-1-A", "duplicates_removed"), 3: ("GO-1-A", "centroid_resolved"),
        4: (None, "unresolvable"), 5: ("GO-2-C", "geometry_resolved"), 6: (None, "duplicates_removed"),
        7: (None, "unresolvable"), 8: (None, "unresolvable"), 9: (None, "unresolvable"),
        10: (None, "unresolvable"), 11: ("GO-7-Z", "resolved_clean"),
    }
    counts = R.reconciliation(out.resolved).first().asDict()
    assert counts["input_rows"] == 11 == sum(counts[b] for b in R.BUCKETS)
    cad = R.listed_parcels(out, land)
    assert {r.row_key for r in cad.collect()} == {1, 3}
    assert R.resolution_counts(out.resolved, cad).first()[:] == (3, 2, 1)
    assert R.quality_counts(land).first()[:] == (0, 1)


def test_axis_flip_is_repaired(spark, stages):
    land = parcels_of(spark, [(1, "GO-1-A", "GO", "M1", 5.0, wkt_box(-50, -16, -49.9, -15.9))])
    rows = [(1, "GO-1-A", None), (2, "", wkt_box(-16, -50, -15.9, -49.9)), (3, "", "POINT (-15.95 -49.95)")]
    listed = spark.createDataFrame(rows, "row_id long, raw_id string, raw_wkt string")
    out = R.resolve(stages.keep("p", R.prepare(listed, POLICY)), land, POLICY, stages)
    assert [r.resolution for r in out.resolved.orderBy("row_id").collect()] == [
        "resolved_clean", "axis_repaired", "axis_repaired"
    ]


def test_injected_defects_resolve_back(spark, stages):
    names = [f"GO-{i}-P{i}" for i in range(6)]
    land = parcels_of(spark, [
        (i, n, "GO", f"M{i}", 5.0, wkt_box(-50 + i, -16, -49.5 + i, -15.5)) for i, n in enumerate(names)
    ])
    donors = dict(zip(("duplicate", "centroid", "geometry", "axis_flip"), names))
    made = X.inject(land, donors)
    assert made.count() == 8
    listed = made.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("cod_imovel").alias("raw_id"),
        F.col("geometry").alias("raw_wkt"), "defect",
    )
    out = R.resolve(stages.keep("p", R.prepare(listed, POLICY)), land, POLICY, stages)
    row = R.reconciliation(out.resolved).first()
    assert row[:] == (8, 3, 1, 1, 1, 1, 1, 6)


# -- matching -----------------------------------------------------------------------

def test_primary_parcel_is_the_least_id_among_the_best(spark):
    """Random shares against a plain fold; shares a little apart on either side of the tolerance."""
    rng, tol = random.Random(11), POLICY.primary_tie_tolerance
    rows = []
    for field in range(40):
        top = rng.choice([0.2, 0.7, 1.0])
        for _ in range(rng.randint(1, 6)):
            share = top - rng.choice([0, 0, tol / 7, tol * 3, 0.1])
            rows.append((field, f"P{rng.randint(1, 9)}", share * 64.0, 64.0))
    rows.append((99, "P5", 0.0, 0.0))
    got = {r.field_id: r for r in M.primary_parcel(spark.createDataFrame(rows, "field_id long, cod_imovel string, inter_area double, field_area double"), POLICY).collect()}
    for field in {r[0] for r in rows} - {99}:
        shares = [(c, x / y) for f, c, x, y in rows if f == field]
        best = max(x for _, x in shares)
        assert got[field].primary_cod_imovel == min(c for c, x in shares if best - x <= tol)
        assert got[field].max_single_frac == best
    assert (got[99].primary_cod_imovel, got[99].max_single_frac) == ("P5", None)


def test_dominant_class_is_the_widest(spark):
    rng = random.Random(12)
    rows = [(f"P{rng.randint(0, 20)}", rng.choice([15.0, 39.0, 41.0, None]), float(rng.randint(1, 4))) for _ in range(300)]
    got = dict(map(tuple, M.dominant_class(spark.createDataFrame(rows, "cod_imovel string, mbmode24 double, field_area_ha double")).collect()))
    want = {}
    for parcel in {r[0] for r in rows}:
        sums = {c: sum(h for p, k, h in rows if p == parcel and k == c) for c in (15.0, 39.0, 41.0) if any(p == parcel and k == c for p, k, _ in rows)}
        if sums:
            want[parcel] = min(c for c in sums if sums[c] == max(sums.values()))
    assert got == want


def test_excluded_counts_touching_fields_that_neither_rule_admits(spark):
    rng = random.Random(13)
    rows = [(k, rng.choice([None, 0.0, 0.25, 0.9]), 0.5, rng.random() < 0.3, rng.random() < 0.3) for k in range(200)]
    decision = spark.createDataFrame(rows, "field_id long, max_single_frac double, union_frac double, by_primary boolean, by_aggregate boolean")
    want = sum(1 for _, share, _, one, many in rows if share and not one and not many)
    assert M.excluded_count(decision).first()[0] == want


def test_decision_with_sliver_overlap_and_touch(spark, stages):
    cad = parcels_of(spark, [
        (1, "GO-1-A", "GO", "M", 1.0, wkt_box(0, 0, 0.1, 0.1)), (2, "GO-1-B", "GO", "M", 1.0, wkt_box(0.08, 0, 0.18, 0.1)),
        (3, "GO-1-C", "GO", "M", 1.0, wkt_box(0.1801, 0, 0.25, 0.1)), (4, "GO-1-B", "GO", "M", 1.0, wkt_box(0.08, 0, 0.18, 0.1)),
    ])
    fields = shapes(spark, [
        (1, wkt_box(0.01, 0.01, 0.02, 0.02)),           # inside A
        (2, wkt_box(0.17, 0.02, 0.1901, 0.04)),         # half in B, half in C, over a sliver
        (3, wkt_box(0.24, 0.02, 0.265, 0.04)),          # 40 % in C
        (4, wkt_box(0.085, 0.02, 0.095, 0.03)),         # inside the overlap of A and B
        (5, wkt_box(0.1, 0.1, 0.11, 0.12)),             # touches B only
        (6, wkt_box(0.1, 0.10005, 0.11, 0.1002)),       # in the cushion only
        (7, wkt_box(5, 5, 6, 6)),
    ], "Id long")
    got = {r.field_id: r for r in M.match_fields(fields, cad, POLICY, stages).collect()}
    assert len(got) == 7
    assert got[1].by_primary and got[1].primary_cod_imovel == "GO-1-A"
    assert not got[2].by_primary and got[2].by_aggregate and got[2].union_frac == pytest.approx(1.0, abs=1e-9)
    assert not got[3].by_primary and not got[3].by_aggregate and got[3].max_single_frac == pytest.approx(0.4)
    assert got[4].primary_cod_imovel == "GO-1-A" and got[4].max_single_frac == pytest.approx(1.0)
    assert got[5].max_single_frac == 0 and got[5].primary_cod_imovel == "GO-1-A"
    assert got[6].max_single_frac == 0 and got[6].primary_cod_imovel is None and got[6].union_frac > 0.5
    for row in got.values():
        assert row.union_frac >= row.max_single_frac - 1e-12


def test_many_overlapping_pieces_merge_in_chunks(spark, stages):
    rng = random.Random(2)
    rows, pieces = [], []
    for i in range(300):
        x, y, w = rng.uniform(-0.02, 0.1), rng.uniform(-0.02, 0.1), 0.01
        rows.append((i, f"GO-1-{i}", "GO", "M", 1.0, f"POLYGON (({x} {y}, {x + w} {y}, {x + w / 2} {y + w}, {x} {y}))"))
        pieces.append([(x, y), (x + w, y), (x + w / 2, y + w)])
    cad = parcels_of(spark, rows + [(1000 + i, *r[1:]) for i, r in enumerate(rows[:200])])
    fields = shapes(spark, [(1, wkt_box(0, 0, 0.1, 0.1)), (2, "POLYGON ((0 0, 0.1 0, 0.05 0.1, 0 0))")], "Id long")
    no_gap = Policy(neighbor_gap_tolerance_m=0.0)
    import numpy as np

    from landledger.functions.sweep import _closed

    flat = [_closed(np.array(p)) for p in pieces]
    square = _closed(np.array([[0, 0], [0.1, 0], [0.1, 0.1], [0, 0.1]]))
    roof = _closed(np.array([[0, 0], [0.1, 0], [0.05, 0.1]]))
    for hot in (50, 500_000):
        from landledger.plans.stages import Stages

        st = Stages.of(spark, f"{stages.root}-{hot}")
        got = {r.field_id: r.union_frac for r in M.union_fraction(fields, cad, no_gap, st, hot).collect()}
        assert got[1] == pytest.approx(cover(square, flat) / 0.01, rel=1e-9)
        assert got[2] == pytest.approx(cover(roof, flat) / 0.005, rel=1e-9)


def test_enrichment_of_fields(spark):
    cols = "Id long, mbmode24 double, mode_year double, deforestarea0104 double, deforestarea0509 double, " \
           "deforestarea1014 double, deforestarea1520 double, deforestarea2124 double, ha double"
    rows = [(1, 15.0, 2005.0, None, 0.0, 0.0, 0.0, 0.0, 2.0), (2, 40.0, 2005.0, 5000.0, 5000.0, None, 0.0, 5000.0, 1.0),
            (3, 39.0, 2005.0, 100.0, 900.0, 900.0, 0.0, 0.0, 0.0)]
    out = M.enrich_fields(spark.createDataFrame(rows, cols), F.col("ha")).orderBy("Id").collect()
    assert [r.mb_class for r in out] == ["Pasture", "Class 40", "Soybean"]
    assert [r.defor_era for r in out] == ["None", "2021-2024", "2010-2014"]
    assert [r.cleared_share for r in out] == [0.0, 1.0, 0.0]
    assert [r.post2020_loss_ha for r in out] == [0.0, 0.5, 0.0] and out[1].has_post2020_loss


def test_policy_tables(spark):
    scope, routing = scope_table(spark), routing_table(spark)
    assert scope.count() == 13 and scope.filter("in_scope").count() == 5
    assert routing.select("mbmode24").distinct().count() == 6


# -- contacts --------------------------------------------------------------------------

CANDIDATE = "cod_imovel string, cod_ibge string, entity_id string, entity_kind string, tier string, basis string, " \
            "evidence_value double, distance_km double, flags string"


def test_candidates_come_in_order_and_stop_at_the_cap(spark):
    """Random candidates against Python's sort."""
    rng = random.Random(14)
    order = {"membership_muni": 0, "intake_point": 1, "slaughter_point": 1, "mill_point": 2, "gravity_catchment": 3}
    rows = []
    for k in range(400):
        tier = rng.choice(list(order))
        far = rng.choice([None]) if tier in ("membership_muni", "gravity_catchment") else float(rng.randint(1, 6))
        rows.append((f"P{rng.randint(0, 30)}", "1", f"e{k:03d}", "any", tier, "b", float(rng.randint(1, 3)), far, rng.choice(["", "", "nearest_by_far"]) if far else ""))
    got = C.rank_candidates(spark.createDataFrame(rows, CANDIDATE), POLICY).collect()
    want = set()
    for parcel in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == parcel), key=lambda r: (-1 if r[8] else order[r[4]], math.inf if r[7] is None else r[7], -r[6], r[2]))
        want |= {(parcel, k + 1, r[2]) for k, r in enumerate(mine[: POLICY.max_candidates])}
    assert {(r.cod_imovel, r.rank, r.entity_id) for r in got} == want


def _spots(spark, rows):
    return spark.createDataFrame(rows, "cod_imovel string, cod_ibge string, x_km double, y_km double")


def _points(spark, rows):
    cols = "entity_id string, entity_kind string, tier string, basis string, weight double, x_km double, y_km double"
    return spark.createDataFrame([(e, "buyer", t, "observed", w, x, 0.0) for e, t, w, x in rows], cols)


def test_delivery_radius_and_flags(spark, stages):
    points = _points(spark, [
        ("near", "slaughter_point", 1.0, 5.0), ("mill", "mill_point", 1.0, 6.0), ("small", "intake_point", 999.0, 7.0),
        ("p99", "slaughter_point", 1.0, 99.0), ("p150", "slaughter_point", 1.0, 150.0), ("p301", "slaughter_point", 1.0, 301.0),
    ])
    spots = _spots(spark, [("A", "1", 0.0, 0.0), ("B", "1", 320.0, 0.0), ("C", "1", 450.0, 0.0), ("D", "1", 5000.0, 0.0)])
    got = {}
    for r in C.delivery(spots, points, POLICY, stages, hot_rows=2).collect():
        got.setdefault(r.cod_imovel, {})[r.entity_id] = (r.flags, r.radius_km)
    assert got["A"] == {
        "near": ("nearest_by_far", 100.0), "mill": ("town_centroid", 100.0), "p99": ("", 100.0),
    }
    assert got["B"] == {"p301": ("widened", 170.0), "p150": ("widened", 170.0)}
    assert got["C"] == {"p301": ("widened", 300.0), "p150": ("widened", 300.0)}
    assert "D" not in got


def test_routing_keeps_what_the_crop_allows(spark):
    crops = [("P", 15.0), ("S", 39.0), ("A", 18.0), ("K", 46.0), ("U", 99.0), ("N", None)]
    cad = spark.createDataFrame(crops, "cod_imovel string, dominant_mb double")
    got = {}
    for r in C.allowed_tiers(cad, scope_table(spark), routing_table(spark)).collect():
        got.setdefault(r.cod_imovel, set()).add(r.tier)
    every = {"intake_point", "slaughter_point", "mill_point", "gravity_catchment"}
    assert got == {
        "P": {"slaughter_point"}, "S": {"intake_point", "gravity_catchment"},
        "A": {"intake_point", "mill_point", "gravity_catchment"}, "U": every, "N": every,
    }


def test_reconciliation_counts_copies_and_keeps_the_unmatched(spark):
    ids = spark.createDataFrame([("A",), ("A",), ("B",)], "cod_imovel string")
    cand = spark.createDataFrame([
        ("A", "1", "e", "coop", "membership_muni", "o", 1.0, None, ""),
        ("A", "1", "f", "buyer", "intake_point", "o", 1.0, 3.0, "widened nearest_by_far"),
    ], CANDIDATE)
    got = {r.cod_imovel: r[1:] for r in V.candidate_reconciliation(ids, cand).collect()}
    assert got == {"A": (4, 2, 2, 1, 0, 1), "B": (0, 0, 0, 0, 1, 0)}


def test_catalog_children(spark):
    rows = [([("child", "./a/collection.json"), ("child", "./b/catalog.json"), ("root", "x/collection.json")],)]
    cat = spark.createDataFrame(rows, "links array<struct<rel:string,href:string>>")
    assert V.catalog_children(cat).first()[:] == (1, "trazo3-fields")


def test_two_policies_do_not_share_stages(spark):
    from dataclasses import replace

    from landledger.derive import PLANE
    from landledger.portfolio import Portfolio

    strict = Portfolio(spark, "/root/testdata/sf0.001").decision
    loose = Portfolio(spark, "/root/testdata/sf0.001", replace(PLANE, contain_threshold=0.05)).decision
    assert (strict.filter("by_primary").count(), loose.filter("by_primary").count()) == (331, 603)


def test_other_input_under_one_name_is_another_stage(spark, stages):
    assert stages.keep("x", spark.range(3)).count() == 3
    assert stages.keep("x", spark.range(5)).count() == 5
    stages.drop()


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from landledger.session import checkpoint_root

    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__))

    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_root(session(**{"spark.master": master}))
    assert checkpoint_root(session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
