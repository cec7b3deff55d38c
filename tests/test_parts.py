import pytest
from pyspark.sql import functions as F

from gridloom.operators import chips as L
from gridloom.operators import predict as P
from gridloom.operators import stats as N
from gridloom.sources import files as S


def test_percentiles_over_many_rows_equal_the_built_in(spark):
    """Brackets are used from 4000 rows of a group; ties, skew and small groups included."""
    rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 == 0, 7.0).otherwise(F.pow(F.rand(4) * 10, 5)).alias("v"))
    rows = rows.union(spark.createDataFrame([(9, 1.5), (9, 2.5), (10, 4.0)], "g long, v double"))
    rows.write.mode("overwrite").parquet(path := S.scratch(spark, "percentiles"))
    rows, at = spark.read.parquet(path), [0.0, 0.001, 0.02, 0.25, 0.5, 0.98, 1.0]
    got = {r.g: list(r["_p"]) for r in N.percentiles(rows, ["g"], "v", at).collect()}
    want = {r.g: list(r.p) for r in rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("p")).collect()}
    assert got.keys() == want.keys()
    for g in got:
        assert got[g] == pytest.approx(want[g], rel=1e-12)
    assert list(N.percentiles(rows, [], "v", at).first()["_p"]) == pytest.approx(list(rows.agg(F.percentile("v", F.array(*map(F.lit, at)))).first()[0]), rel=1e-12)
    assert N.percentiles(rows.limit(0), ["g"], "v", at).count() == 0


def test_unresolved_names_are_told(spark):
    resolved = spark.createDataFrame([("a", [1]), ("b", []), ("c", [2, 3])], "name string, channels array<int>")
    with pytest.raises(ValueError, match="b"):
        L.require_channels(resolved)
    with pytest.raises(ValueError, match="b, c"):
        L.require_channels(resolved, single=True)
    assert L.require_channels(resolved.where("name <> 'b'")).count() == 2


def test_window_starts_as_listed(spark):
    px = spark.range(60).select((F.col("id") % 60).alias("px_row"), F.lit(3).alias("px_col"))
    for n, size, step in ((60, 16, 7), (60, 16, 20), (10, 16, 4), (60, 60, 5), (57, 8, 8)):
        got = {(r.px_row, r.row0) for r in P.window_explode(px.where(F.col("px_row") < n), n, 8, size, step).collect()}
        assert got == {(i, s) for i in range(n) for s in P.starts(n, size, step) if s <= i < s + size}


def test_predict_windows_sees_whole_windows(spark):
    px = spark.range(64).selectExpr("id div 8 AS px_row", "id % 8 AS px_col")
    windows = P.window_explode(px, 8, 8, 4, 4)

    def model(pdf):
        return pdf.assign(p=float(len(pdf)))[["row0", "col0", "px_row", "px_col", "p"]]

    out = P.predict_windows(windows, model, "row0 int, col0 int, px_row long, px_col long, p double")
    assert out.count() == 64 and out.where("p <> 16").count() == 0


def test_scan_reads_what_it_needs(spark):
    px = spark.range(4096).selectExpr("id % 2 AS tile", "id div 64 AS px_row", "id % 64 AS px_col", "id * 1.0D AS b1", "id * 2.0D AS b2")
    path = S.scratch(spark, "scan")
    S.write_raster(px, path, "tile", 16)
    cut = S.scan(spark, path, "tile", 1, ["b2"], (20, 10, 30, 20), 16)
    assert cut.count() == px.where("tile = 1 AND px_row BETWEEN 20 AND 49 AND px_col BETWEEN 10 AND 29").count()
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "b1" not in plan and "block_row" in plan and "GreaterThanOrEqual(px_row" in plan
    assert S.scan(spark, path, "tile", 1).count() == 2048
    assert S.scan(spark, path, "tile", 1, ["b1"], (0, 0, 0, 5), 16).count() == 0


def test_tile_sketches_merge(spark):
    """Statistics from stored tile sketches: exact with the pixels, within the rank error without; tiles can come in any order."""
    px = spark.range(60_000).select((F.col("id") % 7).alias("tile_id"), F.when(F.col("id") % 11 > 0, F.pow(F.rand(5) * 10, 4)).alias("b1"), (F.col("id") % 40).cast("double").alias("b2"), F.lit(None).cast("double").alias("b3"))
    px.write.parquet(path := S.scratch(spark, "px"))
    px, bands = spark.read.parquet(path), ["b1", "b2", "b3"]
    for t in (3, 0, 6, 1, 2, 5, 4):
        N.tile_sketches(px.where(f"tile_id = {t}"), bands).write.mode("append").parquet(kept := f"{path}-sketches")
    kept = spark.read.parquet(kept)
    want = {r.band: r for r in N.band_stats(px, bands).collect()}
    exact = {r.band: r for r in N.stats_from_sketches(kept, px, bands).collect()}
    near = {r.band: r for r in N.stats_from_sketches(kept).collect()}
    assert exact.keys() == want.keys() == near.keys() == {"b1", "b2"}
    for b in want:
        assert list(exact[b])[1:] == pytest.approx(list(want[b])[1:], rel=1e-9)
        rank = px.where(F.col(b) <= near[b].median).count() / px.where(F.col(b).isNotNull()).count()
        assert rank >= 0.5 - 3 * N.SKETCH_ERROR and px.where(F.col(b) < near[b].median).count() / want[b].n_samples <= 0.5 + 3 * N.SKETCH_ERROR
    moved = N.tile_sketches(px.withColumn("b1", F.col("b1") + 1e6), bands)  # brackets that miss: worked out anew
    assert {r.band: r.median for r in N.stats_from_sketches(moved, px, bands).collect()} == {b: pytest.approx(r.median) for b, r in want.items()}
    assert N.stats_from_sketches(kept.limit(0), px.limit(0), bands).count() == 0
