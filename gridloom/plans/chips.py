"""Queries on chips, labels, channels, regression matrices and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chips as L
from ..operators import grid as G
from ..operators import mask as M
from ..sources import files as S
from ..sources.views import label_polys, land_mask, oracle, scene, scene_px, table
from .grids import polygons
from .stats import clean, rounded

SIZE = 32
_CHIP = ("chip_row", "chip_col")
_BANDS = ("b2", "b4")


def labelled(spark, sf_dir, frame: int = 256):
    """The grid, or a smaller frame with partial chips at its edges, with land, label and two clean bands, by chip."""
    land = land_mask(spark).select("px_row", "px_col", M.land_isclose("mask", -9999.0).alias("land"))
    label = G.rasterize(land, L.map_labels(polygons(spark, sf_dir)), "code")
    px = land.join(label, ["px_row", "px_col"]).join(clean(spark, sf_dir).select("px_row", "px_col", *_BANDS), ["px_row", "px_col"], "left")
    return L.chip_cells(px.where(f"px_row < {frame} AND px_col < {frame}"), SIZE)


def l01_map_labels(spark, sf_dir):
    return L.map_labels(label_polys(spark, sf_dir)).select("poly_id", "cls", "code")


def l02_chip_grid(spark, sf_dir):
    return L.chip_grid(scene(spark, sf_dir).select("px_row", "px_col"), SIZE, 250, 250)


def l09_chip_metadata(spark, sf_dir):
    return L.chip_metadata(L.chip_counts(labelled(spark, sf_dir), _BANDS), SIZE, G.Grid())


def l10_chip_ledger(spark, sf_dir):
    counts = L.chip_counts(labelled(spark, sf_dir, 250), _BANDS)
    return counts.groupBy(L.chip_reason(SIZE).alias("reason")).agg(F.count("*").alias("n"))


def l11_class_pixel_counts(spark, sf_dir):
    return L.class_pixel_counts(labelled(spark, sf_dir))


def _catalog(spark, sf_dir):
    """Predictors: a nation's name and 1 to 3 bands each, their file, group and whether they are normalised."""
    nation = table(spark, sf_dir, "nation").withColumn("file", F.concat(F.lower("n_name"), F.lit(".tif")))
    kind = F.when(F.col("n_regionkey") == 0, "terrain").otherwise("sentinel")
    return nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 + 1).alias("n_bands"), "file", kind.alias("grp"), (F.col("n_nationkey") % 4 != 0).alias("normalised"))


def l12_channel_map(spark, sf_dir):
    return L.channel_map(_catalog(spark, sf_dir), ["file", "grp", "normalised"])


def l13_resolve_channels(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("no "), F.col("n_name"))).otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("name"))
    return L.resolve_channels(l12_channel_map(spark, sf_dir), wanted).select("name", F.array_join(F.col("channels").cast("array<string>"), ",").alias("channels"))


def l13_require_channels(spark, sf_dir):
    """The bands of predictors of one band each, all of which must resolve."""
    wanted = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.lower("n_name").alias("name"))
    found = L.require_channels(L.resolve_channels(l12_channel_map(spark, sf_dir), wanted), single=True)
    return found.select("name", F.get("channels", F.lit(0)).cast("bigint").alias("channel"))


def l14_drop_channels(spark, sf_dir):
    kept = L.drop_channels(F.array(*M.BANDS), (0, 4, 9))
    return scene(spark, sf_dir).select("px_row", "px_col", F.size(kept).alias("n"), F.get(kept, F.lit(0)).alias("first"), F.get(kept, F.lit(6)).alias("last"))


def l17_audit_chips(spark, sf_dir):
    """A quarter of the 8 x 8 chips; some have a third channel."""
    a, b = M.INDICES["ndvi"]
    px = L.chip_cells(scene(spark, sf_dir), 8).select(*_CHIP, (F.col("b2") / 2000).alias("s"), ((F.col(a) - F.col(b)) / (F.col(a) + F.col(b))).alias("i"))
    chips = px.groupBy(*_CHIP).agg(F.collect_list("s").alias("s"), F.collect_list("i").alias("i"))
    odd = F.col("chip_col") % 5 == 0
    chips = chips.select(*_CHIP, F.when(odd, F.array("s", "i", "s")).otherwise(F.array("s", "i")).alias("bands"))
    return rounded(L.audit_chips(chips, ["scaled", "ndvi"], list(_CHIP)))


def l15_categorical(spark, sf_dir):
    return scene(spark, sf_dir).select("px_row", "px_col", (F.col("b4") / 100 + 0.5).alias("v")).select("px_row", "px_col", L.categorical("v", 22).alias("v"))


def l16_clean_labels(spark, sf_dir):
    return scene(spark, sf_dir).select("px_row", "px_col", (F.col("b4").cast("bigint") % 7 - 1).alias("label")).select("px_row", "px_col", L.clean_labels().cast("bigint").alias("label"))


def l17_audit(spark, sf_dir):
    px = scene(spark, sf_dir).select(*[((F.col(a) - F.col(b)) / (F.col(a) + F.col(b))).alias(n) for n, (a, b) in M.INDICES.items()], (F.col("b2") / 2000).alias("scaled"))
    return rounded(L.audit(px, [*M.INDICES, "scaled"]))


def m25_propagate_null(spark, sf_dir):
    return L.propagate_null(labelled(spark, sf_dir), _BANDS).select("px_row", "px_col", "label", *_BANDS)


def r01_regression_matrix(spark, sf_dir):
    px = clean(spark, sf_dir)
    label = G.rasterize(land_mask(spark), L.map_labels(polygons(spark, sf_dir)), "code")
    return L.regression_matrix(label, [px.select("px_row", "px_col", "b2"), px.select("px_row", "px_col", "b7")], ["b2", "b7"])


def r04_class_distribution(spark, sf_dir):
    return L.class_distribution(r01_regression_matrix(spark, sf_dir))


def _paths(spark, sf_dir):
    """One made-up drive path for each part."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("C:\\data\\"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("path"))


def s04_split_predictors(spark, sf_dir):
    return S.split_predictors(_paths(spark, sf_dir))


def s05_rebase_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", S.rebase("path", "/mosaic/").alias("rebased"), S.mount_drive("path").alias("mounted"))


def s06_output_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.output_name("p_name", "_epsg25833_cog.tif").alias("name"))


#: The suffixes that outputs of the steps have.
SUFFIXES = ("_epsg25833_cog.tif", "_masked_ch.tif", "_DLready.tif", "_mosaic.tif")


def s06_output_suffixes(spark, sf_dir):
    names = F.array(*[S.output_name("p_name", x) for x in SUFFIXES])
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(names).alias("kind", "name"))


def _halves(spark, sf_dir):
    keys = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 8).alias("zone"))
    return keys, keys.where("p_partkey % 3 <> 0 OR zone = 2")


def s10_pair_chips(spark, sf_dir):
    keys, done = _halves(spark, sf_dir)
    return S.pair_chips(keys.where("p_partkey % 5 <> 0"), done, "p_partkey")


def s01_scan(spark, sf_dir):
    """Two bands of a window of one stored tile."""
    path = S.scratch(spark, "rasters")
    S.write_raster(scene_px(spark, sf_dir), path, "tile_id", 64)
    return S.scan(spark, path, "tile_id", 2, ["b2", "b4"], (40, 30, 120, 150), 64).withColumn("tile_id", F.col("tile_id").cast("bigint"))


def s13_item_report(spark, sf_dir):
    """Items written as JSON and read back."""
    path = S.scratch(spark, "report")
    items = topo_status(spark, sf_dir)
    S.write_report(items, path)
    return S.read_report(spark, path, items.schema)


def s17_select_band(spark, sf_dir):
    return S.select_band(scene(spark, sf_dir), "b4")


def m02_land_valid(spark, sf_dir):
    px = land_mask(spark, sf_dir)
    return px.select("px_row", "px_col", M.land_valid("mask", -9999.0).alias("land"), M.land_valid(F.nullif("mask", F.lit(-9999.0))).alias("any"))


def m03_mask_gt(spark, sf_dir):
    return land_mask(spark, sf_dir).select("px_row", "px_col", M.mask_gt("mask").alias("keep"), M.mask_gt(F.nullif("mask", F.lit(1.0)), -10000.0).alias("low"))


def s13_run_report(spark, sf_dir):
    return S.run_report(topo_status(spark, sf_dir), "zone")


def topo_status(spark, sf_dir):
    keys, done = _halves(spark, sf_dir)
    return S.lookup(keys, done.select("p_partkey", F.lit("skipped").alias("status")), "p_partkey", "status", "written")


def s14_pending(spark, sf_dir):
    keys, done = _halves(spark, sf_dir)
    return S.pending(keys, done, "p_partkey")


def s14_pending_zones(spark, sf_dir):
    keys, done = _halves(spark, sf_dir)
    return S.pending_zones(keys, done, "zone", "p_partkey")


def s16_quarantine(spark, sf_dir):
    good, bad = S.split_good_bad(scene_px(spark, sf_dir), (F.col("b2") > 0) & (F.col("b2") < 60000))
    count = lambda df, v: df.groupBy("tile_id").agg(F.count("*").alias("n")).withColumn("good", F.lit(v))
    return count(good, True).unionByName(count(bad, False))


def d03_mosaic_sources(spark, sf_dir):
    keys, done = _halves(spark, sf_dir)
    return S.mosaic_sources(keys.union(keys), done, "p_partkey")


def d08_lookup(spark, sf_dir):
    return topo_status(spark, sf_dir).select("p_partkey", "status")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0] in "lmrsd" and k[1:3].isdigit()}

_IN = "x > x0 AND y > y0 AND CASE WHEN shape = 'box' THEN x < x0 + w AND y < y0 + w ELSE (x - x0) + (y - y0) < w END"
_CLEAN = "clean AS (SELECT px_row, px_col, " + ", ".join(f"CASE WHEN NOT ({b} = 0 OR {b} >= 60000) THEN {b} END AS {b}" for b in ("b2", "b4", "b7")) + " FROM scene)"
_LAB = f"lab AS (SELECT g.px_row, g.px_col, any_value(land) AS land, coalesce(max_by(CASE cls WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, poly_id), 0) AS label FROM (SELECT px_row, px_col, px_col + 0.5 AS x, px_row + 0.5 AS y, mask <> -9999 AS land FROM land_mask) g LEFT JOIN (SELECT * FROM label_polys WHERE cls IS NOT NULL) ON {_IN} GROUP BY 1, 2)"
_PX = "px AS (SELECT lab.*, b2, b4, b2 IS NOT NULL AND b4 IS NOT NULL AS ok, lab.px_row // 32 AS chip_row, lab.px_col // 32 AS chip_col FROM lab LEFT JOIN clean USING (px_row, px_col))"
_CH = "ch AS (SELECT chip_row, chip_col, count(*) FILTER (WHERE label > 0) AS nl, count(*) FILTER (WHERE land) AS land, count(*) FILTER (WHERE ok) AS nv, count(*) FILTER (WHERE ok AND label = 1) AS l1, count(*) FILTER (WHERE ok AND label = 2) AS l2, count(*) FILTER (WHERE ok AND label = 3) AS l3 FROM px GROUP BY 1, 2)"
_chip = lambda body: oracle(f"WITH {_CLEAN}, {_LAB}, {_PX}, {_CH}\n{body}", "scene", "land_mask", "label_polys")
_MAP = "SELECT row_number() OVER (ORDER BY n_nationkey, band) - 1 AS channel_idx, n_name AS predictor, band FROM nation, range(1, 4) t(band) WHERE band <= n_nationkey % 3 + 1"
_PATH = "'C:\\data\\' || replace(p_name, ' ', '_') || '_' || p_partkey || '.tif'"
_DONE = "(p_partkey % 3 <> 0 OR p_partkey % 8 = 2)"
_IDX = [(n, f"({a} - {b}) / ({a} + {b})") for n, (a, b) in M.INDICES.items()] + [("scaled", "b2 / 2000")]
ORACLES = {
    "l01_map_labels": oracle("SELECT poly_id, cls, CASE cls WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS code FROM label_polys WHERE cls IS NOT NULL", "label_polys"),
    "l02_chip_grid": oracle("SELECT px_row, px_col, px_row // 32 AS chip_row, px_col // 32 AS chip_col FROM scene WHERE px_row < 224 AND px_col < 224", "scene"),
    "l09_chip_metadata": _chip("SELECT format('tile_{:06d}', row_number() OVER (ORDER BY chip_row, chip_col) - 1) AS tile_id, (500000 + chip_col * 320)::DOUBLE AS xmin, (7000000 - (chip_row + 1) * 320)::DOUBLE AS ymin, (500000 + (chip_col + 1) * 320)::DOUBLE AS xmax, (7000000 - chip_row * 320)::DOUBLE AS ymax, (500000 + chip_col * 320 + 160)::DOUBLE AS center_x, (7000000 - chip_row * 320 - 160)::DOUBLE AS center_y, chip_col * 32 AS pixel_col, chip_row * 32 AS pixel_row, nv AS n_valid_pixels, nl / 1024 AS label_ratio, l1 AS n_label_low, l2 AS n_label_medium, l3 AS n_label_high FROM ch WHERE nl / 1024 >= 0.15 AND land >= 50 AND nv > 0"),
    "l10_chip_ledger": _chip("SELECT CASE WHEN chip_row = 7 OR chip_col = 7 THEN 'edge' WHEN nl = 0 THEN 'no_label' WHEN nl / 1024 < 0.15 THEN 'ratio' WHEN land < 50 THEN 'land' WHEN nv = 0 THEN 'invalid' ELSE 'created' END AS reason, count(*) AS n FROM ch GROUP BY 1").replace("FROM lab LEFT JOIN clean USING (px_row, px_col))", "FROM lab LEFT JOIN clean USING (px_row, px_col) WHERE lab.px_row < 250 AND lab.px_col < 250)"),
    "l11_class_pixel_counts": _chip("SELECT label, count(*) AS n FROM px WHERE label > 0 GROUP BY ROLLUP (label)"),
    "l12_channel_map": f"SELECT m.*, lower(predictor) || '.tif' AS file, CASE WHEN n_regionkey = 0 THEN 'terrain' ELSE 'sentinel' END AS grp, n_nationkey % 4 <> 0 AS normalised FROM ({_MAP}) m JOIN nation ON n_name = predictor",
    "l13_require_channels": f"SELECT lower(predictor) AS name, channel_idx::BIGINT AS channel FROM ({_MAP}) m JOIN nation ON n_name = predictor WHERE n_nationkey % 3 = 0",
    "l14_drop_channels": oracle("SELECT px_row, px_col, 7 AS n, b2 AS first, b9 AS last FROM scene", "scene"),
    "l17_audit_chips": oracle("WITH p AS (SELECT *, px_row // 8 AS cr, px_col // 8 AS cc FROM scene), k AS (SELECT *, md5('42:' || cr || ':' || cc) AS h FROM p), q AS (SELECT * FROM k WHERE ('0x' || substr(h, 1, 8))::BIGINT < 1073741824), v AS (SELECT 'scaled' AS channel, b2 / 2000 AS v FROM q UNION ALL SELECT 'ndvi', (b7 - b3) / (b7 + b3) FROM q) SELECT channel, count(v) AS n, count(*) FILTER (WHERE v IS NULL) AS n_null, round(min(v), 6) AS min, round(max(v), 6) AS max, round(100.0 * count(*) FILTER (WHERE abs(v) > 1) / count(v), 6) AS pct_out, 100.0 * count(*) FILTER (WHERE abs(v) > 1) / count(v) < 1 AS passed, (SELECT count(DISTINCT (cr, cc)) FROM q) AS n_chips, (SELECT count(DISTINCT (cr, cc)) FROM q WHERE cc % 5 = 0) AS n_wrong FROM v GROUP BY channel", "scene"),
    "s01_scan": oracle("SELECT tile_id, px_row, px_col, b2, b4 FROM scene_px WHERE tile_id = 2 AND px_row BETWEEN 40 AND 159 AND px_col BETWEEN 30 AND 179", "scene_px"),
    "s13_item_report": f"SELECT p_partkey, p_partkey % 8 AS zone, CASE WHEN {_DONE} THEN 'skipped' ELSE 'written' END AS status FROM part",
    "s17_select_band": oracle("SELECT px_row, px_col, b4 AS v FROM scene", "scene"),
    "m02_land_valid": oracle("SELECT px_row, px_col, mask <> -9999 AS land, mask <> -9999 AS any FROM land_mask", "land_mask"),
    "m03_mask_gt": oracle("SELECT px_row, px_col, mask > 0 AS keep, mask = -9999 AS low FROM land_mask", "land_mask"),
    "l13_resolve_channels": f"SELECT w.name, coalesce(string_agg(channel_idx::VARCHAR, ',' ORDER BY channel_idx), '') AS channels FROM (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'no ' || n_name ELSE ' ' || lower(n_name) END AS name FROM nation) w LEFT JOIN ({_MAP}) m ON lower(trim(m.predictor)) = lower(trim(w.name)) GROUP BY 1",
    "l15_categorical": oracle("SELECT px_row, px_col, CASE WHEN round_even(b4 / 100 + 0.5, 0) BETWEEN 0 AND 22 THEN round_even(b4 / 100 + 0.5, 0) ELSE 0 END::INT AS v FROM scene", "scene"),
    "l16_clean_labels": oracle("SELECT px_row, px_col, CASE WHEN b4::BIGINT % 7 - 1 BETWEEN 0 AND 3 THEN b4::BIGINT % 7 - 1 ELSE 0 END AS label FROM scene", "scene"),
    "l17_audit": oracle(" UNION ALL ".join(f"SELECT '{n}' AS channel, count(v) AS n, count(*) FILTER (WHERE v IS NULL) AS n_null, round(min(v), 6) AS min, round(max(v), 6) AS max, round(100.0 * count(*) FILTER (WHERE abs(v) > 1) / count(v), 6) AS pct_out, 100.0 * count(*) FILTER (WHERE abs(v) > 1) / count(v) < 1 AS passed FROM (SELECT {e} AS v FROM scene)" for n, e in _IDX), "scene"),
    "m25_propagate_null": _chip("SELECT px_row, px_col, CASE WHEN ok THEN label ELSE 0 END AS label, CASE WHEN ok THEN b2 END AS b2, CASE WHEN ok THEN b4 END AS b4 FROM px"),
    "r01_regression_matrix": _chip("SELECT px_row, px_col, label, b2, b7 FROM lab JOIN clean USING (px_row, px_col) WHERE label > 0 AND b2 IS NOT NULL AND b7 IS NOT NULL"),
    "r04_class_distribution": _chip("SELECT label, count(*) AS n FROM lab JOIN clean USING (px_row, px_col) WHERE label > 0 AND b2 IS NOT NULL AND b7 IS NOT NULL GROUP BY 1"),
    "s04_split_predictors": f"SELECT p_partkey, {_PATH} AS path, {_PATH} = (SELECT min({_PATH}) FROM part) AS is_main FROM part",
    "s05_rebase_paths": "SELECT p_partkey, '/mosaic/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.tif' AS rebased, '/mnt/c/data/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.tif' AS mounted FROM part",
    "s06_output_name": "SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9_]+', '_', 'g')) || '_epsg25833_cog.tif' AS name FROM part",
    "s06_output_suffixes": "SELECT p_partkey, kind, lower(regexp_replace(p_name, '[^A-Za-z0-9_]+', '_', 'g')) || ['_epsg25833_cog.tif', '_masked_ch.tif', '_DLready.tif', '_mosaic.tif'][kind + 1] AS name FROM part, range(4) r(kind)",
    "s10_pair_chips": f"SELECT p_partkey, x AS has_x, y AS has_y, x AND y AS paired FROM (SELECT p_partkey, p_partkey % 5 <> 0 AS x, {_DONE} AS y FROM part) WHERE x OR y",
    "s13_run_report": f"SELECT p_partkey % 8 AS zone, CASE WHEN {_DONE} THEN 'skipped' ELSE 'written' END AS status, count(*) AS n FROM part GROUP BY 1, 2",
    "s14_pending": f"SELECT p_partkey, p_partkey % 8 AS zone FROM part WHERE NOT {_DONE}",
    "s14_pending_zones": f"SELECT DISTINCT p_partkey % 8 AS zone FROM part WHERE NOT {_DONE}",
    "s16_quarantine": oracle("SELECT tile_id, count(*) AS n, b2 > 0 AND b2 < 60000 AS good FROM scene_px GROUP BY 1, 3", "scene_px"),
    "d03_mosaic_sources": f"SELECT p_partkey FROM part WHERE {_DONE}",
    "d08_lookup": f"SELECT p_partkey, CASE WHEN {_DONE} THEN 'skipped' ELSE 'written' END AS status FROM part",
}
