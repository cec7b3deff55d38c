import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import catalog
from gridloom.operators import chips as L
from gridloom.operators import forest as T
from gridloom.operators import grid as G
from gridloom.operators import project as J
from gridloom.sources import files as S

SF = "/root/testdata/sf0.001"


def test_known_points(spark):
    points = spark.createDataFrame([(15.0, 0.0), (15.0, 60.0), (None, 60.0)], "x double, y double")
    out = J.to_crs_points(points, "EPSG:4258", "EPSG:25833").collect()
    assert out[0][:] == pytest.approx((500000, 0), abs=1e-3)
    assert out[1][:] == pytest.approx((500000, 6651411.190), abs=1e-2)
    assert out[2]["x"] is None
    with pytest.raises(ValueError):
        J.zone("EPSG:3857")


def test_reproject_against_points(spark):
    """Every cell holds the value of the source pixel at its centre, by a plain mercator integral-free check: the way there and back."""
    g = G.Grid(crs="EPSG:32632", width=6, height=5)
    px = spark.range(30).select(F.expr("id div 6").alias("px_row"), (F.col("id") % 6).alias("px_col"), F.col("id").cast("double").alias("v"))
    out, to = J.reproject(px, g, "EPSG:25833", 10.0, ["v"])
    centres = J.to_crs_points(J.cells_of(spark, to).withColumns(G.xy(to)), to.crs, g.crs).collect()
    want = {}
    for r in centres:
        row, column = math.floor((r["y"] - g.f) / g.e), math.floor((r["x"] - g.c) / g.a)
        if 0 <= row < 5 and 0 <= column < 6:
            want[r["px_row"], r["px_col"]] = row * 6.0 + column
    assert {(r["px_row"], r["px_col"]): r["v"] for r in out.collect()} == want
    assert 24 <= len(want) <= 36 and len(set(want.values())) > 20
    same, grid = J.reproject(px, g, g.crs, 10.0, ["v"])
    assert same.count() == 30 and (grid.width, grid.height) == (6, 5)


def test_polygons_with_bad_lines(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1]]
    rows = [
        {"properties": {"k": 1}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"properties": {"k": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}, "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::32632"}}},
        {"properties": {"k": 3}, "geometry": None},
        {"properties": {"k": 4}, "geometry": {"type": "Polygon", "coordinates": [[[0]]]}},
    ]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, rows)))
    out = {r["k"]: r for r in S.read_polygons(spark, str(tmp_path / "p.json"), "k int", "EPSG:25833").collect()}
    assert len(out[1]["rings"]) == 1 and len(out[2]["rings"]) == 2 and out[3]["rings"] is None and out[4]["rings"] is None
    assert [out[k]["crs_ok"] for k in (1, 2, 3)] == [True, False, True]


def test_npy_import(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype="f4").reshape(2, 3))
    (tmp_path / "b.npy").write_bytes(b"junk")
    out = {r["name"]: r for r in S.read_npy_dir(spark, str(tmp_path)).collect()}
    assert out["a"]["shape"] == [2, 3] and out["a"]["values"] == [0, 1, 2, 3, 4, 5] and out["a"]["error"] is None
    assert out["b"]["values"] is None and out["b"]["error"]


def test_transpose_and_mask_of_nulls(spark):
    df = spark.createDataFrame([(0, [[1, 2], [3, None]]), (1, []), (2, None)], "k int, a array<array<int>>").withColumn("t", L.transpose("a"))
    assert [r["t"] for r in df.orderBy("k").collect()] == [[[1, 3], [2, None]], [], None]
    one = spark.createDataFrame([([1.0, None],), ([1.0],), (None,)], "bands array<double>").select(L.valid_mask())
    assert [r[0] for r in one.collect()] == [False, True, None]


def test_forest_learns_and_ranks(spark):
    rows = [(float(i % 10), float(i * 7 % 11), int(i % 10 > 4), i % 3, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, label int, fold int, weight double")
    preds, found = T.cross_validate(df, ["a", "b"], "fold", 3, lambda d: T.fit_rf(d, ["a", "b"], weight="weight", trees=5, depth=4))
    assert preds.count() == 300 and preds.where("pred = label").count() > 290
    best = T.ranking(found, ["a", "b"], 1).collect()
    assert best[0]["name"] == "a" and found.count() == 6
    model = T.fit_gbt(df, ["a", "b"], rounds=2, depth=2)
    assert T.predicted(model, df).where("pred = label").count() > 290
    none, _ = T.cross_validate(df.limit(0), ["a", "b"], "fold", 2, T.fit_rf)
    assert none.count() == 0


def test_rows_of_model_queries(spark):
    assert sum(r["n"] for r in catalog.QUERIES["c06_fit_rf"](spark, SF).collect()) > 5000
    assert catalog.QUERIES["c10_importances"](spark, SF).count() == 2


def test_nodes_walked_by_sql_and_joins(spark, tmp_path):
    """A forest's predictions from its node table: by joins, and by a recursive query of another engine."""
    px = spark.range(600).selectExpr("id", "(id * 37) % 101 / 10D AS a", "(id * 53) % 97 * 1D AS b").withColumn("label", ((F.col("a") > 4).cast("int") + (F.col("b") > 60).cast("int") * F.when(F.col("id") % 9 > 0, 1).otherwise(0)).cast("int"))
    px.write.parquet(str(tmp_path / "px"))
    px = spark.read.parquet(str(tmp_path / "px"))
    trees, depth = 12, 9
    model = T.fit_rf(px, ["a", "b"], trees=trees, depth=depth)
    nodes = T.node_table(model, spark)
    nodes.write.parquet(str(tmp_path / "nodes"))
    want = {r.id: r.pred for r in T.predicted(model, px).collect()}
    walked = T.walk(px, "id", ["a", "b"], nodes, trees, depth)
    assert {r.id: r.pred for r in walked.collect()} == want and len(set(want.values())) == 3
    assert T.walk(px.limit(0), "id", ["a", "b"], nodes, trees, depth).count() == 0
    sql = f"""WITH RECURSIVE nodes AS (SELECT * FROM '{tmp_path}/nodes/*.parquet'), px AS (SELECT * FROM '{tmp_path}/px/*.parquet'),
    w AS (SELECT id, a, b, tree, 0 AS node FROM px, (SELECT DISTINCT tree FROM nodes)
      UNION ALL SELECT id, a, b, w.tree, CASE WHEN (CASE n.feature WHEN 0 THEN a ELSE b END) <= threshold THEN n."left" ELSE n."right" END FROM w JOIN nodes n USING (tree, node) WHERE n.feature IS NOT NULL),
    v AS (SELECT id, k, sum(votes[k + 1]) AS s FROM w JOIN nodes USING (tree, node), range(3) r(k) WHERE votes IS NOT NULL GROUP BY 1, 2)
    SELECT id, arg_max(k, (s, -k)) FROM v GROUP BY 1"""
    assert dict(duckdb.sql(sql).fetchall()) == want


def test_boosting_ends_by_held_rows(spark):
    px = spark.range(400).selectExpr("id", "id % 20 * 1D AS a", "id % 7 * 1D AS b", "CAST(id % 20 > 9 AS int) AS label", "id % 4 = 0 AS held")
    model = T.fit_gbt(px, ["a", "b"], rounds=40, depth=3, rate=0.5, held="held", tol=0.2)
    kept = [m.getNumTrees for m in model.stages[-1].models]
    assert max(kept) < 40
    assert T.predicted(model, px).where("pred <> label").count() == 0


def test_held_out_counts(spark):
    counts = {(r["label"], r["pred"]): r["n"] for r in catalog.QUERIES["c06_held_out"](spark, SF).collect()}
    n = sum(counts.values())
    assert 800 < n < 2000 and sum(v for (a, b), v in counts.items() if a == b) > 0.7 * n


def test_control_points_change_no_row(spark):
    """Blocks of any size give the exact series' pixels, also over a wide and turned area; most cells are interpolated."""
    for crs, block, g in (("EPSG:25835", 16, G.Grid(c=300000.0, width=70, height=50)), ("EPSG:25833", 7, G.Grid(crs="EPSG:32631", c=420000.0, a=500.0, e=-400.0, width=40, height=60)), ("EPSG:25833", 64, G.Grid(crs="EPSG:32632", width=30, height=20))):
        px = spark.range(g.width * g.height).select(F.expr(f"id div {g.width}").alias("px_row"), (F.col("id") % g.width).alias("px_col"), F.col("id").alias("v"))
        res = abs(g.a)
        want, to = J.reproject(px, g, crs, res, ["v"])
        got, same = J.reproject(px, g, crs, res, ["v"], block)
        assert to == same
        want = sorted(tuple(r) for r in want.select("px_row", "px_col", "v").collect())
        assert sorted(tuple(r) for r in got.select("px_row", "px_col", "v").collect()) == want and len(want) > 100
    exact = J.source_pixels(J.cells_of(spark, to), to, g).collect()
    near = {(r.px_row, r.px_col): (r._r, r._c) for r in J.block_pixels(spark, to, g, 64).collect()}
    assert len(near) == len(exact) and max(abs(near[r.px_row, r.px_col][i] - (r._r, r._c)[i]) for r in exact for i in (0, 1)) < 0.01
    assert sum(near[r.px_row, r.px_col] == (r._r, r._c) for r in exact) < len(exact) / 4
