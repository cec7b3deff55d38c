import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import chips as L
from gridloom.operators import mosaic as D
from gridloom.operators import predict as P
from gridloom.operators.order import numbered_in_order
from gridloom.sources import files as S
from gridloom.sources import layout as B
from gridloom.streaming.mosaic import mosaic_stream, read_mosaic

SCHEMA = "px_row long, px_col long, tile long, b1 double, b2 double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_rasters_meet_without_exchange(spark):
    B.co_located(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        px = spark.range(4096).selectExpr("id div 64 AS px_row", "id % 64 AS px_col", "id % 5 AS tile", "CAST(id AS double) AS v")
        parts = [px.where(f"px_col % 7 <> {i}").withColumnRenamed("v", f"v{i}").drop("tile") for i in range(4)]
        stored = [B.store_blocks(p, f"part{i}", 16, 8) for i, p in enumerate(parts)]
        both = L.stack_rasters(stored, B.KEYS)
        by_chip = both.groupBy(*B.BLOCK).agg(F.count("*").alias("n"))
        mosaic = D.mosaic_last(B.store_blocks(px, "tiles", 16, 8), ["tile"], ["v"], B.KEYS, "v")
        for df in (both, by_chip, mosaic):
            assert "Exchange" not in plan_of(df)
        plain = L.stack_rasters(parts)
        assert "Exchange" in plan_of(plain)
        assert sorted(both.select(plain.columns).collect()) == sorted(plain.collect())
        assert by_chip.agg(F.sum("n")).first()[0] == plain.count() and mosaic.count() == 4096
        assert B.store_blocks(px.limit(0), "none", 16, 8).count() == 0
        assert B.store_blocks(px.withColumn("px_row", F.when(F.col("px_row") > 0, F.col("px_row"))), "nulls", 16, 8).count() == 4032
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert [B.buckets_for(n) for n in (0, 1, 1 << 22, (1 << 25) + 1, 10**12)] == [8, 8, 8, 16, 1 << 18]


def data_files(target):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(f"{target}/data") for n in names if n.endswith(".parquet")}


def test_mosaic_takes_tiles_as_they_come(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    px = spark.range(1024).selectExpr("id div 32 AS px_row", "id % 32 AS px_col")
    tile = lambda t, where: px.where(where).selectExpr("px_row", "px_col", f"{t}L AS tile", f"CASE WHEN (px_row + px_col + {t}) % 5 > 0 THEN {t} * 1000D + px_row END AS b1", "px_col * 1D AS b2")
    # a late tile of a lower order, one over it, and one that touches a corner only
    tiles = [tile(2, "px_row < 20"), tile(1, "px_col < 20"), tile(3, "px_row >= 28 AND px_col >= 28")]
    files, union = {}, None
    for i, t in enumerate(tiles):
        t.coalesce(1).write.mode("append").parquet(source)
        mosaic_stream(spark, source, SCHEMA, target, log, ["tile"], ["b1", "b2"], 8).awaitTermination()
        union = t if union is None else union.union(t)
        want = D.mosaic_last(union, ["tile"], ["b1", "b2", "tile"])
        got = read_mosaic(spark, target, SCHEMA)
        assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
        now = data_files(target)
        assert all(now[f] == at for f, at in files.items())
        new = {f.split("version=")[1].split("/", 1)[1].rsplit("/", 1)[0] for f in now if f not in files}
        assert len(new) == (12, 12, 1)[i]  # blocks of 8 x 8 that the tile has a pixel in
        files = now
    os.remove(next(f"{source}/{n}" for n in os.listdir(source) if n.endswith(".parquet")))
    assert read_mosaic(spark, target, SCHEMA).count() == want.count()
    assert read_mosaic(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_counts_come_with_the_write(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    px = spark.range(1000).selectExpr("id AS px", "CASE WHEN id % 3 = 0 THEN id END AS v").mapInArrow(counted, "px long, v long")
    told = S.write_observed(px, str(tmp_path / "a"), {"n": F.count("*"), "n_v": F.count("v"), "top": F.max("v")}).first()
    assert tuple(told) == (1000, 334, 999) and calls.value == 1000
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1000
    assert tuple(S.write_observed(px.limit(0), str(tmp_path / "b"), {"n": F.count("*"), "top": F.max("v")}).first()) == (0, None)


def tiff(width, height, bands, order="<", big=False, cut=None):
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "H", 43 if big else 42)
    tags = [(256, 3, width), (257, 4, height), (277, 3, bands), (258, 3, 8)]
    if big:
        head += struct.pack(order + "HHQ", 8, 0, 16)
        body = struct.pack(order + "Q", len(tags)) + b"".join(struct.pack(order + "HHQ", t, k, 1) + struct.pack(order + {3: "H", 4: "I"}[k], v).ljust(8, b"\0") for t, k, v in tags)
    else:
        head += struct.pack(order + "I", 8)
        body = struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHI", t, k, 1) + struct.pack(order + {3: "H", 4: "I"}[k], v).ljust(4, b"\0") for t, k, v in tags)
    return (head + body)[:cut]


def test_probe_tells_broken_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    files = {"a.tif": tiff(10, 20, 3), "b.tiff": tiff(300, 70000, 64, ">"), "c.tif": tiff(5, 6, 1, big=True), "d.tif": b"", "e.tif": b"plain text, no raster", "f.tif": tiff(1, 1, 1, cut=20), "g.tif": b"II*\0", "a b/h.tif": tiff(7, 8, 2)}
    files |= {"i.tif": b"broken", "i.tiff": tiff(9, 9, 1), "A.txt": b""}  # the readable file of a name comes first
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = {r.name: r for r in S.discover(spark, str(tmp_path), probe=True).collect()}
    told = {n: (r.status, r.width, r.height, r.bands) for n, r in rows.items()}
    assert told == {"a": ("ok", 10, 20, 3), "b": ("ok", 300, 70000, 64), "c": ("ok", 5, 6, 1), "e": ("not a raster", None, None, None)} | {
        "f": ("truncated", None, None, None), "g": ("truncated", None, None, None), "h": ("ok", 7, 8, 2), "i": ("ok", 9, 9, 1)}
    assert rows["i"].path.endswith("i.tiff") and rows["a"].length == len(files["a.tif"])
    some = {r.name: r for r in S.discover(spark, str(tmp_path), names=["a", "d", "no", "a"], probe=True).collect()}
    assert {n: r.status for n, r in some.items()} == {"a": "ok", "d": "missing", "no": "missing"} and some["no"].path is None
    assert {r.name: r.path is None for r in S.discover(spark, str(tmp_path), names=["a", "no"]).collect()} == {"a": False, "no": True}


def test_numbers_in_order(spark):
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 9 > 0 THEN id % 7 END AS k")
    got = numbered_in_order(df.repartition(7), [F.asc_nulls_last("k"), F.desc("id")], "n")
    assert "SinglePartition" not in plan_of(got)
    rows = sorted(got.collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(1, 2001))
    assert [r.id for r in rows] == [r.id for r in sorted(rows, key=lambda r: (r.k is None, r.k or 0, -r.id))]
    assert numbered_in_order(df.limit(0), [F.asc("k")]).count() == 0
    folds = P.kfold(df.select("id"), 3, F.col("id")).groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in folds) == [(0, 667), (1, 667), (2, 666)]
    assert sorted(r.fold for r in P.kfold(df.limit(2), 5, F.col("id")).collect()) == [0, 1]


@pytest.mark.parametrize("shape", [(50, 41, 16, 7, 16), (10, 37, 12, 4, 8), (30, 30, 8, 8, 64), (9, 9, 16, 4, 4)])
def test_blocks_with_borders_equal_windows(spark, shape):
    height, width, size, step, block = shape
    r = np.random.default_rng(5)
    rows = [(i, j, *(None if r.random() < 0.1 else float(r.normal()) for _ in range(2))) for i in range(height) for j in range(width) if r.random() < 0.6 and not (i < 5 and j < 5)]
    px = spark.createDataFrame(rows, "px_row long, px_col long, a double, b double")
    bands = ["a", "b"]
    windows = P.prep_windows(P.window_explode(px, height, width, size, step), bands)
    y, x = F.col("px_row") - F.col("row0"), F.col("px_col") - F.col("col0")
    want = P.blend(windows.withColumn("p", F.array(F.col("a") + 0.01 * y, F.col("b") * 0.02 * x)), 2)

    def model(w, row0, col0):
        at = np.arange(size)
        return np.stack([w[..., 0] + 0.01 * at[None, :, None], w[..., 1] * 0.02 * at[None, None, :]], axis=-1)

    got = P.predict_blocks(px, bands, height, width, size, step, model, 2, block)
    a, b = ({(r.px_row, r.px_col): (r.weight, *r.p) for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) == got.count()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)
    assert P.predict_blocks(px.limit(0), bands, height, width, size, step, model, 2, block).count() == 0
