"""Steps whose intermediate rows may grow no faster than their input."""

import json
import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from landledger import derive as D
from landledger import readback
from landledger.functions import geometry as G
from landledger.functions import pairing
from landledger.operators import candidates as C
from landledger.operators import grading as Q
from landledger.operators import match as M
from landledger.plans.spatial import box_pairs
from landledger.policy import MEMBERSHIP, routing_table, scope_table
from landledger.portfolio import Portfolio
from landledger.readback import list_encodings
from landledger.sources import lists
from landledger.sources.files import write_collections
from landledger.sources.runs import read_answers


def test_candidates_form_no_more_cooperatives_of_a_municipality_than_are_ranked(spark, stages):
    k = F.col("id")
    cad = spark.range(60).select(
        F.concat(F.lit("S-1-"), k.cast("string")).alias("cod_imovel"), F.lit("1").alias("cod_ibge"), F.lit(39.0).alias("dominant_mb"),
        *[k.cast("double").alias(c) for c in ("cx", "cy", "x_km", "y_km")])
    place = G.point(F.lit(-500.0), F.lit(-500.0))
    weight = F.when(k % 9 != 0, (k % 20).cast("double"))
    coops = G.with_shape(spark.range(40).select(
        F.lit("1").alias("entity_id"), F.lit("cooperative").alias("entity_kind"), F.lit(MEMBERSHIP).alias("tier"),
        weight.alias("weight"), F.lit("observed").alias("basis"), place.alias("geometry"),
    )).withColumns({"x_km": F.col("xmin"), "y_km": F.col("ymin")})
    ranked = C.match_candidates(cad, coops, scope_table(spark), routing_table(spark), D.PLANE, stages)
    every = next(df for name, df in stages.written.items() if name.startswith("every_candidate"))
    assert every.count() == 60 * D.PLANE.max_candidates
    weights = sorted((k % 20 for k in range(40) if k % 9), reverse=True)[: D.PLANE.max_candidates]
    got = {}
    for r in ranked.orderBy("cod_imovel", "rank").collect():
        got.setdefault(r.cod_imovel, []).append(r.evidence_value)
    assert len(got) == 60 and all(v == weights for v in got.values())


def test_matched_fields_and_enriched_parcels_are_written_without_their_shapes(spark):
    portfolio = Portfolio(spark, "/root/testdata/sf0.001")
    assert not {"edges", "is_box"} & set(portfolio.matched.columns)
    assert portfolio.matched.schema["geometry"].dataType.names == ["kind"]
    assert not {"edges", "geometry"} & set(portfolio.enriched.columns)


def test_copies_of_a_shape_are_one_row_before_pairs_are_formed(spark, stages):
    land = spark.range(30).withColumn("geometry", G.box(F.lit(0), F.lit(0), 1 + F.col("id") % 3, F.lit(2)))
    cad = G.with_shape(land.select(F.col("id").alias("row_key"), F.lit("P").alias("cod_imovel"), "geometry"))
    fields = G.with_shape(spark.range(4).select(F.col("id").alias("Id"), G.box(F.lit(0), F.lit(0), F.lit(4), F.lit(2)).alias("geometry")))
    shares = M.union_fraction(fields, cad, D.PLANE, stages).collect()
    assert {(r.field_id, r.union_frac) for r in shares} == {(k, 0.75) for k in range(4)}
    shapes = next(df for name, df in stages.written.items() if name.startswith("union_shapes"))
    assert shapes.count() == 3


def test_edges_of_boxes_are_told_again_by_their_bounds(spark):
    wkt = F.when(F.col("id") == 0, "POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))").otherwise("POLYGON ((1 1, 9 1, 1 9, 1 1))")
    rows = G.with_shape(spark.range(2).select("id", G.from_wkt(wkt).alias("geometry")))
    pairs = box_pairs(rows, rows, "id", "id", 16.0, carry_left=["is_box", "edges"], carry_right=["is_box", "edges"])
    given = {r.id: r.edges for r in rows.collect()}
    told = pairs.collect()
    assert len(told) == 4
    assert all(r.l_edges == given[r.l_id] and r.r_edges == given[r.r_id] for r in told)


def test_answer_files_are_read_once_by_as_many_tasks_as_a_shuffle_has(spark, tmp_path):
    for k in range(200):
        file = tmp_path / "m" / f"r{k}" / "answers" / "q1.csv"
        file.parent.mkdir(parents=True)
        file.write_text(f"a,b\n{k},x\n")
    rows, heads = read_answers(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("REPARTITION_BY_NUM") == 1, plan
    assert rows.count() == heads.count() == 200


def test_rows_of_tables_are_dealt_by_key_before_they_are_counted(spark):
    left = spark.createDataFrame([(1, ["a"]), (1, ["a"]), (1, ["b"]), (2, ["a"]), (3, ["c"])], "k int, cells array<string>")
    right = spark.createDataFrame([(1, ["b"]), (1, ["a"]), (1, ["a"]), (2, ["a"]), (2, ["a"])], "k int, cells array<string>")
    told = Q.identical_tables(left, right, ["k"])
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert {(r.k, r.identical) for r in told.collect()} == {(1, True), (2, False), (3, False)}


def test_lists_that_one_task_reads_are_cut_by_rows(spark, monkeypatch):
    monkeypatch.setattr(readback, "LIST_ROWS", 7)
    assert {r.n_rows for r in list_encodings(spark, "/root/testdata/sf0.001").groupBy("mode").agg(F.sum("n_rows").alias("n_rows")).collect()} == {200}
    root = Path(readback._folder(spark, "/root/testdata/sf0.001", "lists-7"))
    assert all(len(json.loads(p.read_text())["features"]) <= 7 for p in (root / "geojson").iterdir())
    assert all(p.read_text().count("\n") <= 8 for name in ("csv", "split") for p in (root / name).glob("*.csv"))


def test_collections_are_streamed_and_cut_by_rows_whatever_their_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readback, "LIST_ROWS", 7)
    given = spark.createDataFrame([(4,)] * 40 + [(9,), (None,)], "p_partkey bigint")
    given.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    told = {(r.mode, r.form): r.n_rows for r in list_encodings(spark, str(tmp_path)).collect()}
    # each of the 40 rows of a key meets all 40 shapes of it where shapes are a file of their own
    assert told == {(m, f): n for m in ("csv", "geometry", "split", "geojsonl", "geojson") for f, n in ((None, 1), (0, 1), (1, 1600 if m == "split" else 40))}
    written = list(Path(readback._folder(spark, str(tmp_path), "lists-7"), "geojson").iterdir())
    sizes = [len(json.loads(p.read_text())["features"]) for p in written]
    assert max(sizes) <= 7 and sum(sizes) == 42
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("id").alias("cod_imovel")).alias("properties"))
    for n, parts in ((30, 3), (5, 1)):  # a second write leaves nothing of the first
        write_collections(spark.range(n, numPartitions=parts), feature, str(tmp_path / "lists"), 4)
        read = lists.read_list(spark, "geojson", str(tmp_path / "lists"))
        assert sorted(int(r.raw_id) for r in read.collect()) == list(range(n))


def test_column_orders_that_cannot_win_are_not_paired_and_texts_are_compared_once(monkeypatch):
    def cell(text, number=None):
        return {"kind": "s" if number is None else "f", "s": text, "d": number, "n": None}

    golden = [[cell(f"name {k}"), cell(str(k + 0.5), k + 0.5), cell(str(k + 900.5), k + 900.5)] for k in range(20)]
    answer = [[a, b, cell("", c["d"] * 1.5)] for a, b, c in reversed(golden)]
    columns = pairing.both_columns(answer, golden)
    strict = pairing.grid_of(*columns, False, 1.0)
    near = pairing.grid_of(*columns, False, 10.0, strict)
    assert near[0][0] is strict[0][0] and near[1][1] is not strict[1][1]
    alone = pairing.match_grid(answer, golden, False, 10.0)
    assert all((near[i][j] == alone[i][j]).all() for i in range(3) for j in range(3))
    paired = []
    monkeypatch.setattr(pairing.np, "argmin", lambda *a, argmin=np.argmin: paired.append(1) or argmin(*a))
    assert [d["column"] for d in pairing.cell_differences(answer, golden, strict, near, ["a", "b", "c"])] == ["c"] * 20
    assert len(paired) == 20  # one order of six


def test_matching_moves_short_keys_and_each_pair_once(spark, stages):
    k = F.col("id")
    plain = G.with_shape(spark.range(40).select(k.alias("Id"), k.alias("row_key"), F.concat(F.lit("P"), k % 30).alias("cod_imovel"), G.box(k * 2, F.lit(0), k * 2 + 3, F.lit(3)).alias("geometry")))
    M.union_fraction(plain, plain, D.PLANE, stages).collect()
    told = next(df for name, df in stages.written.items() if name.startswith("union_pieces_told"))
    assert dict(told.dtypes)["_copy"] == "bigint"  # a digest of 16 bytes before
    shapes = next(df for name, df in stages.written.items() if name.startswith("union_shapes"))
    assert shapes.select("_copy").distinct().count() == shapes.count() == 40
    found = M.primary_parcel(M.overlaps(plain, plain, D.PLANE), D.PLANE)
    assert not any("cod_imovel" in keys.group() for keys in re.finditer(r"Aggregate \[[^\]]*\]", found._jdf.queryExecution().analyzed().toString()))
