"""Queries on rules, nodata, indices, embeddings, mosaics and value counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mask as M
from ..operators import mosaic as D
from ..sources.views import aef_arrays, land_mask, oracle, scene, scene_px, topo_px
from .masks import _ART, SNOW_SQL, snow_px

#: The rule engine's bounds, in order; a raster's first match counts.
RULES = [(0, "tri", None, 100.0), (1, "spi", None, 100.0), (2, "slope", None, 1e9), (3, "dtm", None, 1e9), (4, "curv", -15.0, 15.0), (5, "aspect", 0.0, 1e9)]


def rule_table(spark):
    return spark.createDataFrame(RULES, "ord int, key string, lower double, upper double")


_RULE_SQL = "CASE WHEN contains(raster_id,'tri') OR contains(raster_id,'spi') THEN v > 100 WHEN contains(raster_id,'slope') OR contains(raster_id,'dtm') THEN v > 1e9 WHEN contains(raster_id,'curv') THEN v < -15 OR v > 15 WHEN contains(raster_id,'aspect') THEN v < 0 OR v > 1e9 END"
_KEYS = ["tile_id", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LAND = "abs(mask + 9999) > 1e-8 + 1e-5 * 9999"


def m08_apply_mask(spark, sf_dir):
    px = M.apply_mask(snow_px(spark, sf_dir))
    return px.groupBy("tile_id").agg(*[F.count(b).alias(f"n_{b}") for b in M.BANDS], *[F.round(F.sum(b), 2).alias(f"sum_{b}") for b in M.BANDS])


def m05_snow_primary(spark, sf_dir):
    return snow_px(spark, sf_dir).where("snow_primary").select(*_KEYS)


def m06_snow_secondary(spark, sf_dir):
    return snow_px(spark, sf_dir).where("snow_secondary").select(*_KEYS)


def m07_snow_legacy(spark, sf_dir):
    return scene_px(spark, sf_dir).groupBy("tile_id").agg(F.count_if(M.snow_legacy()).alias("n_snow"))


def m10_all_null_tiles(spark, sf_dir):
    return M.all_null_tiles(M.apply_mask(snow_px(spark, sf_dir)))


def m11_null_above(spark, sf_dir):
    return M.null_above(topo_px(spark, sf_dir), rule_table(spark).select("ord", "key", "upper")).select("raster_id", "px_id", "v")


def m12_apply_rules(spark, sf_dir):
    return M.null_outside(topo_px(spark, sf_dir), rule_table(spark)).select("raster_id", "px_id", "v", "bad")


def m13_flag_bad(spark, sf_dir):
    return M.flag_bad(M.null_outside(topo_px(spark, sf_dir), rule_table(spark)))


def m14_quick_bad(spark, sf_dir):
    return M.quick_bad(topo_px(spark, sf_dir))


def m15_null_extreme(spark, sf_dir):
    return topo_px(spark, sf_dir).select("px_id", M.null_extreme("v", 1e14).alias("v"), M.null_value("v").alias("no_minus_one"), M.null_below("v", 0.0).alias("not_below"), M.normalize_nodata("v", 1e15).alias("normalized"), M.fill_nodata("v").alias("filled"))


def m16_extract_by_mask(spark, sf_dir):
    land = land_mask(spark).where(M.land_isclose("mask", -9999.0))
    return M.extract_by_mask(scene(spark, sf_dir), land).select("px_row", "px_col", "b1")


def m17_erase_by_mask(spark, sf_dir):
    land = land_mask(spark).where(M.land_isclose("mask", -9999.0))
    return M.erase_by_mask(scene(spark, sf_dir), land).select("px_row", "px_col", "b1")


def m21_orient_mask(spark, sf_dir):
    return M.orient_mask(scene(spark, sf_dir).select("px_row", "px_col", F.when(F.col("b4") > 2000, 1).otherwise(0).alias("mask")))


def m22_mul_mask(spark, sf_dir):
    mask = land_mask(spark).withColumn("mask", F.when(F.col("mask") == 1, 1).otherwise(0))
    return M.mul_mask(scene(spark, sf_dir), mask).select("px_row", "px_col", "b1", "b2")


def m23_dequantize(spark, sf_dir):
    q = aef_arrays(spark, sf_dir).select("vec_id", F.exists("q", lambda x: x == -128).alias("bad"), F.posexplode("q").alias("b", "q"))
    return q.select("vec_id", "b", F.when(~F.col("bad"), F.round(M.dequantize("q"), 9)).alias("v"))


def m24_valid_fraction(spark, sf_dir):
    valid = aef_arrays(spark, sf_dir).select((~F.exists("q", lambda x: x == -128)).alias("valid"))
    return valid.agg(F.round(F.avg(F.col("valid").cast("int")), 9).alias("valid_fraction"))


def i_indices(spark, sf_dir):
    return scene(spark, sf_dir).select("px_row", "px_col", *[F.round(M.index(a, b), 9).alias(n) for n, (a, b) in M.INDICES.items()])


def d01_mosaic_last(spark, sf_dir):
    order = ["tile_id", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    return D.mosaic_last(scene_px(spark, sf_dir), order, ["tile_id", *M.BANDS]).select("px_row", "px_col", "tile_id", *M.BANDS)


def g12_overview(spark, sf_dir):
    return D.overview(scene(spark, sf_dir), 3, ["b1", "b4"]).withColumns({b: F.round(b, 3) for b in ("b1", "b4")})


def n14_value_counts(spark, sf_dir):
    return D.value_counts(scene(spark, sf_dir), "b4").withColumn("pct", F.round("pct", 9))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k.split("_")[0][:1] in "mdgin" and k.split("_")[0][1:].isdigit() or k == "i_indices"}
_SNOW = lambda body: oracle(SNOW_SQL + body, "scene_px", "land_mask")
_MASKED = ", ".join(f"CASE WHEN land AND NOT snow AND NOT {_ART.format(b)} THEN {b} END AS {b}" for b in M.BANDS)
_INDEX = ", ".join(f"round(CASE WHEN abs(({a}-{b})/({a}+{b}+1e-8)) <= 1 THEN ({a}-{b})/({a}+{b}+1e-8) END, 9) AS {n}" for n, (a, b) in M.INDICES.items())
_COLS = ", ".join(_KEYS)
ORACLES = {
    "m05_snow_primary": _SNOW(f"SELECT {_COLS} FROM px WHERE snow_primary"),
    "m06_snow_secondary": _SNOW(f"SELECT {_COLS} FROM px WHERE snow_secondary"),
    "m07_snow_legacy": oracle("SELECT tile_id, count(*) FILTER (WHERE (b2 - b9) / nullif(b2 + b9, 0) > 0.4) AS n_snow FROM scene_px GROUP BY tile_id", "scene_px"),
    "m08_apply_mask": _SNOW(f"SELECT tile_id, {', '.join(f'count({b}) AS n_{b}, round(sum({b}), 2) AS sum_{b}' for b in M.BANDS)} FROM (SELECT tile_id, {_MASKED} FROM px) GROUP BY tile_id"),
    "m10_all_null_tiles": _SNOW(f"SELECT tile_id, count(b1) = 0 AS all_null FROM (SELECT tile_id, {_MASKED} FROM px) GROUP BY tile_id"),
    "m11_null_above": oracle("SELECT raster_id, px_id, CASE WHEN v <= CASE WHEN raster_id IN ('tri','spi') THEN 100 WHEN raster_id LIKE '%curv%' THEN 15 ELSE 1e9 END THEN v END AS v FROM topo_px", "topo_px"),
    "m12_apply_rules": oracle(f"SELECT raster_id, px_id, CASE WHEN NOT coalesce({_RULE_SQL}, false) THEN v END AS v, coalesce({_RULE_SQL}, false) AS bad FROM topo_px", "topo_px"),
    "m13_flag_bad": oracle(f"SELECT raster_id, bool_or(coalesce({_RULE_SQL}, false)) AS is_bad FROM topo_px GROUP BY raster_id", "topo_px"),
    "m14_quick_bad": oracle("SELECT raster_id, coalesce(max(v) > 1e15 OR min(v) < -1e15, true) AS is_bad FROM topo_px GROUP BY raster_id", "topo_px"),
    "m15_null_extreme": oracle("SELECT px_id, CASE WHEN abs(v) <= 1e14 THEN v END AS v, nullif(v, -1) AS no_minus_one, CASE WHEN v >= 0 THEN v END AS not_below, nullif(nullif(v, 1e15), 0) AS normalized, coalesce(v, -9999) AS filled FROM topo_px", "topo_px"),
    "m16_extract_by_mask": oracle(f"SELECT px_row, px_col, b1 FROM scene JOIN land_mask USING (px_row, px_col) WHERE {_LAND}", "scene", "land_mask"),
    "m17_erase_by_mask": oracle(f"SELECT px_row, px_col, b1 FROM scene JOIN land_mask USING (px_row, px_col) WHERE NOT ({_LAND})", "scene", "land_mask"),
    "m21_orient_mask": oracle("SELECT px_row, px_col, CASE WHEN count(*) FILTER (WHERE b4 > 2000) OVER () > count(*) FILTER (WHERE NOT b4 > 2000) OVER () THEN (b4 > 2000)::INT ELSE 1 - (b4 > 2000)::INT END AS mask FROM scene", "scene"),
    "m22_mul_mask": oracle("SELECT px_row, px_col, b1 * (mask = 1)::INT AS b1, b2 * (mask = 1)::INT AS b2 FROM scene JOIN land_mask USING (px_row, px_col)", "scene", "land_mask"),
    "m23_dequantize": oracle("SELECT vec_id, b, CASE WHEN NOT bool_or(q = -128) OVER (PARTITION BY vec_id) THEN round((q / CAST(127.5 AS DOUBLE)) * (q / CAST(127.5 AS DOUBLE)) * sign(q), 9) END AS v FROM aef_q", "aef_q"),
    "m24_valid_fraction": oracle("SELECT round(avg(ok), 9) AS valid_fraction FROM (SELECT (NOT bool_or(q = -128))::INT AS ok FROM aef_q GROUP BY vec_id)", "aef_q"),
    "i_indices": oracle(f"SELECT px_row, px_col, {_INDEX} FROM scene", "scene"),
    "d01_mosaic_last": oracle("SELECT * FROM scene", "scene"),
    "g12_overview": oracle("SELECT px_row // 8 AS px_row, px_col // 8 AS px_col, round(avg(b1), 3) AS b1, round(avg(b4), 3) AS b4 FROM scene GROUP BY 1, 2", "scene"),
    "n14_value_counts": oracle("SELECT b4, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 9) AS pct FROM scene GROUP BY b4", "scene"),
}
