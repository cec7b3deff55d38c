"""Queries on reprojection, stacking, chip building, forests and stored files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chips as L
from ..operators import forest as T
from ..operators import grid as G
from ..operators import mask as M
from ..operators import mosaic as D
from ..operators import predict as P
from ..operators import project as J
from ..operators import stats as N
from ..sources import files as S
from ..sources.views import aef_arrays, oracle, scene, scene_px, table
from .chips import ORACLES as CHIP_SQL
from .chips import SIZE, _catalog, _chip, _MAP, l09_chip_metadata, labelled, r01_regression_matrix
from .grids import polygons
from .stats import _HEAD, clean, rounded

#: The scene taken as one of zone 32, which lies west of the national zone.
WEST = G.Grid(crs="EPSG:32632")
NATIONAL = "EPSG:25833"
EMBEDDED = 64
TERRAIN, SAT, FEATURES = ["b5", "b8"], ["b2", "b4"], ["b2", "b4", "b7"]
ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def g08_reproject(spark, sf_dir):
    return J.reproject(scene(spark, sf_dir).select("px_row", "px_col", "b4"), WEST, NATIONAL, 10.0, ["b4"])[0]


def g08_reproject_blocks(spark, sf_dir):
    """g08_reproject's rows with the series at control points."""
    return J.reproject(scene(spark, sf_dir).select("px_row", "px_col", "b4"), WEST, NATIONAL, 10.0, ["b4"], 32)[0]


def g08_one_way(spark, sf_dir):
    """The scene's pixel centres in the national zone, to a decimetre: finer rounding meets ties that libraries of functions break otherwise."""
    px = scene(spark, sf_dir).select("px_row", "px_col").withColumns(G.xy(WEST))
    return J.to_crs_points(px, WEST.crs, NATIONAL).withColumns({c: F.round(c, 1) for c in ("x", "y")})


def g08_round_trip(spark, sf_dir):
    px = scene(spark, sf_dir).select("px_row", "px_col").withColumns(G.xy(WEST))
    there = J.to_crs_points(px, WEST.crs, NATIONAL)
    return J.to_crs_points(there, NATIONAL, WEST.crs).withColumns({c: F.round(c, 3) for c in ("x", "y")})


def g18_to_crs(spark, sf_dir):
    """The label polygons as degrees and back, by vertex, in millimetres."""
    world = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((500000 + p["x"] * 10).alias("x"), (7000000 - p["y"] * 10).alias("y"))))
    there = J.to_crs(polygons(spark, sf_dir).withColumn("rings", world), NATIONAL, "EPSG:4258")
    back = J.to_crs(there, "EPSG:4258", NATIONAL)
    return back.select("poly_id", F.posexplode(F.element_at("rings", 1)).alias("corner", "p")).select("poly_id", "corner", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


def d02_mosaic_by(spark, sf_dir):
    px = scene_px(spark, sf_dir).withColumn("folder", F.col("tile_id") % 2)
    return D.mosaic_by(px, "folder", ["tile_id", *ORDER], ["tile_id", "b1", "b4"])


def d04_stack(spark, sf_dir):
    return D.stack(scene_px(spark, sf_dir), "tile_id", [0, 1, 2, 3], "b4")


def d04_stack_below(spark, sf_dir):
    return D.stack(scene_px(spark, sf_dir), "tile_id", [0, 1, 2, 3], "b4", separate=False)


def _channels(spark, sf_dir):
    """The labelled grid with satellite channels."""
    px = clean(spark, sf_dir)
    full = labelled(spark, sf_dir).drop("b2", "b4").join(px, ["px_row", "px_col"], "left")
    return L.build_channels(full, N.zscore_stats(px, TERRAIN), TERRAIN, N.read_stats(N.band_stats(px, SAT)), SAT, indices={"ndvi": M.INDICES["ndvi"]})


def _numbers(px, n):
    return rounded(px.select("px_row", "px_col", "label", *[F.get("bands", F.lit(i)).alias(f"c{i}") for i in range(n)]))


def _kept(spark, sf_dir):
    counts = L.chip_counts(labelled(spark, sf_dir), SAT)
    return counts.where(L.chip_reason(SIZE) == "created")


def l05_build_channels(spark, sf_dir):
    return _numbers(_channels(spark, sf_dir), 5)


def l05_build_chips(spark, sf_dir):
    chips = L.build_chips(_channels(spark, sf_dir), _kept(spark, sf_dir))
    total = F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x)
    return chips.select("chip_row", "chip_col", F.size("labels").alias("n"), F.size("bands").alias("n_bands"), total.alias("sum_label"))


def l06_build_channels(spark, sf_dir):
    """The embedding policy: embeddings and a category as they are, terrain z-scored."""
    q = aef_arrays(spark, sf_dir)
    band = lambda i: F.when(F.get("q", F.lit(i)) != -128, F.get("q", F.lit(i)).cast("double")).alias(f"e{i}")
    wide = q.select((F.floor(F.col("vec_id") / 16)).alias("px_row"), (F.col("vec_id") % 16).alias("px_col"), *map(band, range(EMBEDDED)))
    px = wide.join(scene(spark, sf_dir).select("px_row", "px_col", "b5", "b4"), ["px_row", "px_col"]).withColumn("label", F.lit(1))
    px = px.withColumn("kind", (F.col("b4") % 7).cast("int").cast("double"))
    return _numbers(L.build_channels(px, N.zscore_stats(px, ["b5"]), ["b5"], raw=[*(f"e{i}" for i in range(EMBEDDED)), "kind"]), EMBEDDED + 2)


def l18_transpose(spark, sf_dir):
    blocks = G.to_blocks(scene(spark, sf_dir), 32, SAT).select("block_row", "block_col", F.transform("pixels", lambda p: F.array(p["b2"], p["b4"])).alias("last"))
    first = blocks.withColumn("first", L.transpose("last"))
    total = lambda i: F.aggregate(F.get("first", F.lit(i)), F.lit(0.0), lambda a, x: a + x)
    back = (L.transpose("first") == F.col("last")).alias("back")
    return first.select("block_row", "block_col", F.size("first").alias("channels"), F.round(total(0), 3).alias("sum_b2"), F.round(total(1), 3).alias("sum_b4"), back)


def l19_pick_chip(spark, sf_dir):
    chips = scene(spark, sf_dir).selectExpr("px_row div 32 AS chip_row", "px_col div 32 AS chip_col").distinct()
    return L.pick_chip(chips, 42, ["chip_row", "chip_col"])


def r02_feature_names(spark, sf_dir):
    return L.feature_names(_catalog(spark, sf_dir))


def r03_cap(spark, sf_dir):
    return L.cap(r01_regression_matrix(spark, sf_dir), 500, 42, ["px_row", "px_col"])


def c17_valid_mask(spark, sf_dir):
    px = clean(spark, sf_dir)
    return px.select("px_row", "px_col", L.valid_mask(F.array(*M.BANDS)).alias("valid"))


#: Rows sampled for a model, and folds.
SAMPLE, FOLDS = 50_000, 5


def _samples(spark, sf_dir):
    """Stored training rows: the stratified sample of the scene's pixels with a class from three bands, a spatial block's fold and balanced weights."""
    score = (F.col("b2") + F.col("b7")) / 700 + F.col("b4") / 2000
    px = clean(spark, sf_dir).select("px_row", "px_col", *FEATURES).na.drop().withColumn("label", F.pmod(F.floor(score), F.lit(3)).cast("int"))
    px = P.stratified(px, SAMPLE, N.seeded(42, "px_row", "px_col")).withColumn("block", P.block_id(64, 256))
    folds = P.group_kfold(px, "block", FOLDS).select("block", "fold")
    px = px.join(folds, "block").join(F.broadcast(P.balanced_weights(px)), "label")
    path = S.scratch(spark, "samples")
    px.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)  # a bounded sample: one part a core to fit on
    return spark.read.schema(px.schema).parquet(path)


def _forest(df):
    return T.fit_rf(df, FEATURES, weight="weight")


def _counts(preds):
    return preds.groupBy("label", "pred").agg(F.count("*").alias("n"))


def c06_fit_rf(spark, sf_dir):
    """Confusion counts of the final forest on the rows that it was fitted on."""
    px = _samples(spark, sf_dir)
    return _counts(T.predicted(_forest(px), px))


def c06_held_out(spark, sf_dir):
    """Confusion counts of a forest on the first fold, which it wasn't fitted on."""
    px = _samples(spark, sf_dir)
    return _counts(T.predicted(_forest(px.where("fold <> 0")), px.where("fold = 0")))


def c07_cross_validate(spark, sf_dir):
    """The classification report of pooled predictions of five spatial folds."""
    return rounded(P.classification_report(T.cross_validate(_samples(spark, sf_dir), FEATURES, "fold", FOLDS, _forest)[0]))


def c08_fit_gbt(spark, sf_dir):
    """As c06_held_out, by boosted trees whose rounds end by the loss on the second fold."""
    px = _samples(spark, sf_dir).withColumn("held", F.col("fold") == 1)
    return _counts(T.predicted(T.fit_gbt(px.where("fold <> 0"), FEATURES, held="held"), px.where("fold = 0")).drop("held"))


def c10_importances(spark, sf_dir):
    """The two features with the highest mean importance over the folds."""
    return T.ranking(T.cross_validate(_samples(spark, sf_dir), FEATURES, "fold", FOLDS, _forest)[1], FEATURES, 2)


def s07_read_polygons(spark, sf_dir):
    path = S.scratch(spark, "polygons")
    S.write_polygons(polygons(spark, sf_dir), path, NATIONAL)
    read = S.read_polygons(spark, path, "poly_id long, cls string", NATIONAL)
    return read.select("poly_id", "cls", "crs_ok", F.posexplode(F.element_at("rings", 1)).alias("corner", "p")).select("poly_id", "cls", "crs_ok", "corner", "p.x", "p.y")


def s09_chip_store(spark, sf_dir):
    path = S.scratch(spark, "chips")
    S.write_chips(L.build_chips(_channels(spark, sf_dir), _kept(spark, sf_dir)), path)
    return spark.read.parquet(path).select("chip_row", "chip_col", F.size("labels").alias("n"))


def s11_write_metadata(spark, sf_dir):
    path = S.scratch(spark, "metadata")
    chips = l09_chip_metadata(spark, sf_dir)
    S.write_metadata(chips, path)
    return S.read_metadata(spark, path, chips.schema)


def s12_write_matrix(spark, sf_dir):
    path = S.scratch(spark, "matrix")
    S.write_matrix(r01_regression_matrix(spark, sf_dir), path, {"crs": NATIONAL, "source": "scene"})
    return spark.read.parquet(path)


def s18_band_names(spark, sf_dir):
    rasters = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.transform(F.sequence(F.lit(1), (F.col("n_nationkey") % 3 + 1).cast("int")), lambda i: F.concat("n_name", F.lit("_"), i.cast("string"))).alias("band_names"))
    px = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("ord"), (F.col("c_custkey") % 3 + 1).alias("band"))
    return S.band_names(px, rasters, "ord")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0] in "gdlrcs" and k[1:3].isdigit() and f.__module__ == __name__}

_ORD = "tile_id DESC, " + ", ".join(f"{c} DESC" for c in ORDER)
_META = _MAP.replace("SELECT row_number() OVER (ORDER BY n_nationkey, band) - 1 AS channel_idx, n_name AS predictor, band", "SELECT n_nationkey AS ord, n_name AS name, band, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE n_name || '_b' || lpad(band::VARCHAR, 2, '0') END AS feature")
_RING = """SELECT poly_id, cls, shape, x0, y0, w, corner, CASE WHEN corner = 0 THEN x0 WHEN corner = 1 THEN x0 + w WHEN corner = 2 AND shape = 'box' THEN x0 + w ELSE x0 END AS x,
 CASE WHEN corner < 2 THEN y0 ELSE y0 + w END AS y FROM label_polys, range(4) r(corner) WHERE corner < 3 OR shape = 'box'"""
_ZS = "(SELECT avg({0}) FROM {1})", "(SELECT CASE WHEN stddev_pop({0}) < 1e-6 THEN 1 ELSE stddev_pop({0}) END FROM {1})"
_z = lambda b, t: f"({b} - {_ZS[0].format(b, t)}) / {_ZS[1].format(b, t)}"
_r = lambda b: f"({b} - (SELECT median FROM st WHERE band = '{b}')) / (SELECT greatest(iqr, 1e-6) FROM st WHERE band = '{b}')"
_NDVI = "CASE WHEN abs((b7 - b3) / (b7 + b3 + 1e-8)) <= 1 THEN (b7 - b3) / (b7 + b3 + 1e-8) END"
_KEPT = "SELECT chip_row, chip_col, {} FROM ch WHERE nl / 1024 >= 0.15 AND land >= 50 AND nv > 0"


def _zone_sql(src: str, points: str, a: int, b: int) -> str:
    """Points (keys, x, y) of UTM zone a in zone b, in inverse sines and hyperbolic tangents where the operator has others."""
    wave = lambda terms, f, h, u, v: " + ".join(f"({c!r}::DOUBLE) * {f}({2 * j} * {u}) * {h}({2 * j} * {v})" for j, c in enumerate(terms, 1))
    m = lambda z: f"radians({6 * z - 183})"
    keys, radius = points, repr(J._RADIUS)
    s = f"SELECT {keys}, y / {radius}::DOUBLE AS u, (x - 500000) / {radius}::DOUBLE AS v FROM {src}"
    s = f"SELECT {keys}, u - ({wave(J.BETA, 'sin', 'cosh', 'u', 'v')}) AS u, v - ({wave(J.BETA, 'cos', 'sinh', 'u', 'v')}) AS v FROM ({s})"
    s = f"SELECT {keys}, tan(asin(sin(u) / cosh(v))) AS t, atan2(sinh(v), cos(u)) + {m(a)} - {m(b)} AS lam FROM ({s})"
    s = f"SELECT {keys}, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM ({s})"
    return f"SELECT {keys}, 500000 + {radius}::DOUBLE * (eta + {wave(J.ALPHA, 'cos', 'sinh', 'xi', 'eta')}) AS x, {radius}::DOUBLE * (xi + {wave(J.ALPHA, 'sin', 'cosh', 'xi', 'eta')}) AS y FROM ({s})"


def _g08():
    """Reprojection by SQL: the outline's box in the national zone, its cells, and the source pixel of each."""
    side = "SELECT 500000 + i * 128.0::DOUBLE AS x, 7000000 - j * 2560.0::DOUBLE AS y, 0 AS k FROM range(21) r(i), range(2) q(j) UNION ALL SELECT 500000 + j * 2560.0::DOUBLE, 7000000 - i * 128.0::DOUBLE, 0 FROM range(21) r(i), range(2) q(j)"
    box = f"SELECT floor(min(x) / 10) * 10 AS c, ceil(max(y) / 10) * 10 AS f, max(x) AS x1, min(y) AS y0 FROM ({_zone_sql(f'({side})', 'k', 32, 33)})"
    cells = f"SELECT px_row, px_col, c + (px_col + 0.5) * 10 AS x, f - (px_row + 0.5) * 10 AS y FROM box, range(1000) r(px_row), range(1000) q(px_col) WHERE px_row < ceil((f - y0) / 10) AND px_col < ceil((x1 - c) / 10)"
    return f"""WITH box AS ({box}), cells AS ({cells}),
back AS (SELECT px_row, px_col, floor((7000000 - y) / 10)::BIGINT AS r, floor((x - 500000) / 10)::BIGINT AS c FROM ({_zone_sql('cells', 'px_row, px_col', 33, 32)}))
SELECT back.px_row, back.px_col, b4 FROM back JOIN scene ON scene.px_row = back.r AND scene.px_col = back.c"""


def _l05():
    """The channels by SQL, from the chip and the statistics views."""
    from .chips import _LAB

    row = f"SELECT lab.px_row, lab.px_col, label, {_z('b5', 'clean')} AS c0, {_z('b8', 'clean')} AS c1, {_r('b2')} AS c2, {_r('b4')} AS c3, {_NDVI} AS c4 FROM lab LEFT JOIN clean USING (px_row, px_col)"
    ok = " AND ".join(f"c{i} IS NOT NULL" for i in range(5))
    return oracle(f"{_HEAD.rstrip()}, {_LAB}, w AS ({row})\nSELECT px_row, px_col, CASE WHEN {ok} THEN label ELSE 0 END AS label, " + ", ".join(f"CASE WHEN {ok} THEN round(c{i}, 6) END AS c{i}" for i in range(5)) + " FROM w", "scene", "land_mask", "label_polys")


def _l06():
    """The embedding policy by SQL: all bands are lost where one is."""
    bands = range(EMBEDDED)
    wide = ", ".join(f"max(q) FILTER (WHERE b = {i} AND q <> -128)::DOUBLE AS e{i}" for i in bands)
    ok = " AND ".join(f"e{i} IS NOT NULL" for i in bands)
    values = [f"round({_z('b5', 'px')}, 6)", *(f"e{i}" for i in bands), "trunc(kind)::DOUBLE"]
    chosen = ", ".join(f"CASE WHEN ok THEN {v} END AS c{i}" for i, v in enumerate(values))
    return f"""WITH px AS (SELECT s.px_row, s.px_col, a.* EXCLUDE (vec_id, px_row, px_col), {ok} AS ok, b5, (b4 % 7)::BIGINT AS kind
 FROM (SELECT vec_id, px_row, px_col, {wide} FROM aef_q GROUP BY vec_id, px_row, px_col) a JOIN scene s USING (px_row, px_col))
SELECT px_row, px_col, CASE WHEN ok THEN 1 ELSE 0 END AS label, {chosen} FROM px"""


_CENTRES = "(SELECT px_row, px_col, 500000 + (px_col + 0.5) * 10.0::DOUBLE AS x, 7000000 - (px_row + 0.5) * 10.0::DOUBLE AS y FROM scene)"
ORACLES = {
    "g08_reproject": oracle(_g08(), "scene"),
    "g08_reproject_blocks": oracle(_g08(), "scene"),
    "g08_one_way": oracle(f"SELECT px_row, px_col, round(x, 1) AS x, round(y, 1) AS y FROM ({_zone_sql(_CENTRES, 'px_row, px_col', 32, 33)})", "scene"),
    "g08_round_trip": oracle("SELECT px_row, px_col, round(500000 + (px_col + 0.5) * 10, 3)::DOUBLE AS x, round(7000000 - (px_row + 0.5) * 10, 3)::DOUBLE AS y FROM scene", "scene"),
    "g18_to_crs": oracle(f"SELECT poly_id, corner, round(500000 + x * 10, 3) AS x, round(7000000 - y * 10, 3) AS y FROM ({_RING})", "label_polys"),
    "d02_mosaic_by": oracle(f"SELECT folder, px_row, px_col, tile_id, b1, b4 FROM (SELECT *, tile_id % 2 AS folder, row_number() OVER (PARTITION BY tile_id % 2, px_row, px_col ORDER BY {_ORD}) AS rn FROM scene_px) WHERE rn = 1", "scene_px"),
    "d04_stack": oracle("SELECT px_row, px_col, " + ", ".join(f"max(b4) FILTER (WHERE tile_id = {i}) AS v_{i}" for i in range(4)) + " FROM scene_px GROUP BY 1, 2", "scene_px"),
    "d04_stack_below": oracle("SELECT px_row, px_col, tile_id, b4 FROM scene_px", "scene_px"),
    "l05_build_channels": _l05(),
    "l06_build_channels": oracle(_l06(), "scene", "aef_q"),
    "l18_transpose": oracle("SELECT px_row // 32 AS block_row, px_col // 32 AS block_col, 2 AS channels, round(sum(b2), 3) AS sum_b2, round(sum(b4), 3) AS sum_b4, true AS back FROM scene GROUP BY 1, 2", "scene"),
    "l19_pick_chip": oracle("SELECT chip_row, chip_col FROM (SELECT DISTINCT px_row // 32 AS chip_row, px_col // 32 AS chip_col FROM scene) ORDER BY md5('42:' || chip_row || ':' || chip_col), chip_row, chip_col LIMIT 1", "scene"),
    "r02_feature_names": _META,
    "r03_cap": _chip("SELECT px_row, px_col, label, b2, b7 FROM lab JOIN clean USING (px_row, px_col) WHERE label > 0 AND b2 IS NOT NULL AND b7 IS NOT NULL ORDER BY md5('42:' || px_row || ':' || px_col), px_row, px_col LIMIT 500"),
    "c17_valid_mask": oracle("SELECT px_row, px_col, NOT (" + " OR ".join(f"{b} = 0 OR {b} >= 60000" for b in M.BANDS) + ") AS valid FROM scene", "scene"),
    "s07_read_polygons": oracle(f"SELECT poly_id, cls, true AS crs_ok, corner, x, y FROM ({_RING})", "label_polys"),
    "s11_write_metadata": CHIP_SQL["l09_chip_metadata"],
    "s09_chip_store": _chip(_KEPT.format("1024 AS n")),
    "s12_write_matrix": _chip("SELECT px_row, px_col, label, b2, b7, 'EPSG:25833' AS meta_crs, 'scene' AS meta_source FROM lab JOIN clean USING (px_row, px_col) WHERE label > 0 AND b2 IS NOT NULL AND b7 IS NOT NULL"),
    "s18_band_names": "SELECT c_custkey, c_nationkey AS ord, c_custkey % 3 + 1 AS band, CASE WHEN c_custkey % 3 + 1 <= c_nationkey % 3 + 1 THEN n_name || '_' || (c_custkey % 3 + 1) END AS band_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
}
_W = ORACLES["l05_build_channels"]
ORACLES["l05_build_chips"] = f"""WITH px AS ({_W}), kept AS ({CHIP_SQL["l09_chip_metadata"]})
SELECT px_row // 32 AS chip_row, px_col // 32 AS chip_col, count(*) AS n, count(*) AS n_bands, sum(label)::BIGINT AS sum_label FROM px JOIN kept ON px_row // 32 = pixel_row // 32 AND px_col // 32 = pixel_col // 32 GROUP BY 1, 2"""
