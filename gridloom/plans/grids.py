"""Queries on grids, resampling and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..sources.views import label_polys, land_mask, oracle, scene, scene_px

GRID = G.Grid()
#: A coarser grid, off by parts of a cell, and a finer one.
COARSE = G.Grid(c=500003.0, f=6999996.0, a=40.0, e=-40.0, width=64, height=64)
FINE = G.Grid(c=500000.0, f=7000000.0, a=8.0, e=-8.0, width=320, height=320)
CHIP = 32


def polygons(spark, sf_dir):
    """label_polys as rings, in pixel units."""
    point = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    box = F.array(point("x0", "y0"), point("x0 + w", "y0"), point("x0 + w", "y0 + w"), point("x0", "y0 + w"))
    triangle = F.array(point("x0", "y0"), point("x0 + w", "y0"), point("x0", "y0 + w"))
    rings = F.array(F.when(F.col("shape") == "box", box).otherwise(triangle))
    return label_polys(spark, sf_dir).select("poly_id", F.col("poly_id").alias("ord"), "cls", rings.alias("rings"))


def catalog_of(spark, sf_dir):
    """A raster catalog: each tile on the grid, odd tiles a little off it."""
    tile = scene_px(spark, sf_dir).select("tile_id").distinct()
    off = F.col("tile_id") % 2 * 1e-7
    return tile.select("tile_id", F.lit(GRID.crs).alias("crs"), F.lit(GRID.a).alias("a"), F.lit(GRID.e).alias("e"), (GRID.c + off).alias("c"), F.lit(GRID.f).alias("f"), (F.lit(256) + F.when(F.col("tile_id") == 2, 1).otherwise(0)).alias("width"), F.lit(256).alias("height"))


def g01_pixel_xy(spark, sf_dir):
    px = scene(spark, sf_dir).select("px_row", "px_col").withColumns(G.xy(GRID))
    back = G.rowcol(GRID)
    return px.withColumns({"back_row": back["px_row"], "back_col": back["px_col"]})


def g02_bounds(spark, sf_dir):
    return G.bounds(scene_px(spark, sf_dir), GRID)


def g02_extent(spark, sf_dir):
    return G.extent(g02_bounds(spark, sf_dir))


def g03_chip_bounds(spark, sf_dir):
    chips = scene(spark, sf_dir).selectExpr(f"px_row div {CHIP} AS chip_row", f"px_col div {CHIP} AS chip_col").distinct()
    return G.chip_bounds(chips, GRID, CHIP)


def g04_grid_check(spark, sf_dir):
    rasters = catalog_of(spark, sf_dir)
    return rasters.select("tile_id", *[G.grid_check(rasters, GRID, m).alias(m) for m in ("transform", "shape", "tolerance", "signature")])


def g05_overlap(spark, sf_dir):
    boxes = label_polys(spark, sf_dir).selectExpr("poly_id", "x0 AS xmin", "y0 AS ymin", "x0 + w AS xmax", "y0 + w AS ymax")
    window = spark.range(1).selectExpr("60D AS xmin", "50D AS ymin", "190D AS xmax", "170D AS ymax")
    return G.overlap(boxes, window)


def g06_north_up(spark, sf_dir):
    return G.north_up(scene(spark, sf_dir).select("px_row", "px_col", "b1"), 256)


def g07_align_nearest(spark, sf_dir):
    target = spark.range(320).selectExpr("id AS px_row").crossJoin(spark.range(320).selectExpr("id AS px_col"))
    return G.align_nearest(target, scene(spark, sf_dir), FINE, GRID, ["b4"], fill=-9999.0)


def _coarse(spark):
    return spark.range(64).selectExpr("id AS px_row").crossJoin(spark.range(64).selectExpr("id AS px_col"))


def _resampled(method):
    def query(spark, sf_dir):
        return G.resample(_coarse(spark), scene(spark, sf_dir), COARSE, GRID, "b4", method).withColumn("b4", F.round("b4", 4))

    return query


def g10_snap_extent(spark, sf_dir):
    boxes = label_polys(spark, sf_dir).selectExpr("poly_id", "x0 AS xmin", "y0 AS ymin", "x0 + w AS xmax", "y0 + w AS ymax")
    return G.snap_extent(boxes, 10.0)


def g11_mosaic_resolution(spark, sf_dir):
    return catalog_of(spark, sf_dir).agg(F.min(F.abs("a")).alias("res"), F.min(F.abs("e")).alias("res_y"))


def g13_clip_rect(spark, sf_dir):
    return G.clip_rect(scene(spark, sf_dir).select("px_row", "px_col", "b1"), 40, 60, 100, 120)


def g14_clip_by_key(spark, sf_dir):
    polys = polygons(spark, sf_dir).withColumn("basin", F.when(F.col("poly_id") % 10 == 3, F.col("poly_id") - 1).otherwise(F.col("poly_id")))
    px = scene_px(spark, sf_dir).select(F.col("l_suppkey").alias("basin"), "px_row", "px_col", "l_orderkey", "l_linenumber", "b1")
    return G.clip_by_key(px, polys, "basin")


def _labelled(spark, sf_dir):
    return polygons(spark, sf_dir).withColumn("code", F.expr("CASE cls WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END")).where("code IS NOT NULL")


def g15_rasterize(spark, sf_dir):
    return G.rasterize(land_mask(spark), _labelled(spark, sf_dir), "code")


def g16_tile_hits(spark, sf_dir):
    return G.tile_hits(polygons(spark, sf_dir), CHIP, 256 // CHIP, 256 // CHIP)


def g17_erase_buffer(spark, sf_dir):
    return G.erase_buffer(scene(spark, sf_dir).select("px_row", "px_col", "b1"), polygons(spark, sf_dir), 2.0, "b1")


def d07_join_polygons(spark, sf_dir):
    return G.join_polygons(scene(spark, sf_dir).select("px_row", "px_col"), polygons(spark, sf_dir), ["poly_id"])


def s02_blocks(spark, sf_dir):
    blocks = G.to_blocks(scene(spark, sf_dir), 100, ["b1"])
    return blocks.select("block_row", "block_col", F.size("pixels").cast("bigint").alias("n"), F.element_at("pixels", 1)["b1"].alias("first_b1"), F.element_at("pixels", -1)["b1"].alias("last_b1"))


def s02_pixels(spark, sf_dir):
    return G.to_pixels(G.to_blocks(scene(spark, sf_dir), 100, ["b1"]))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[:1] in "gds" and k[1:3].isdigit()}
QUERIES |= {f"g09_resample_{m}": _resampled(m) for m in ("nearest", "bilinear", "cubic", "cubicspline", "lanczos", "average", "mode")}

_IN = "x > x0 AND y > y0 AND CASE WHEN shape = 'box' THEN x < x0 + w AND y < y0 + w ELSE (x - x0) + (y - y0) < w END"
_XY = "px_col + 0.5 AS x, px_row + 0.5 AS y"


def _side(px, py, qx, qy):
    """Squared distance from (x, y) to one side, as SQL."""
    t = f"greatest(0, least(1, ((x-({px}))*(({qx})-({px})) + (y-({py}))*(({qy})-({py}))) / (pow(({qx})-({px}),2)+pow(({qy})-({py}),2))))"
    return f"(pow(x-({px})-{t}*(({qx})-({px})),2) + pow(y-({py})-{t}*(({qy})-({py})),2))"


_BOX = [("x0", "y0"), ("x0+w", "y0"), ("x0+w", "y0+w"), ("x0", "y0+w")]
_TRI = [("x0", "y0"), ("x0+w", "y0"), ("x0", "y0+w")]
_NEAR = {n: "least(" + ", ".join(_side(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1])) + ") <= 4" for n, ring in (("box", _BOX), ("triangle", _TRI))}
_CELLS = "SELECT r.i AS px_row, c.i AS px_col FROM range(64) r(i) CROSS JOIN range(64) c(i)"
_COORDS = f"SELECT px_row, px_col, (4 + (px_row + 0.5) * 40) / 10 - 0.5 AS sy, (3 + (px_col + 0.5) * 40) / 10 - 0.5 AS sx FROM ({_CELLS})"
_D = ["abs(sy - s.px_row)", "abs(sx - s.px_col)"]
_KERNEL = {
    "bilinear": "greatest(0, 1 - {d})",
    "cubic": "CASE WHEN {d} < 1 THEN 1.5*pow({d},3) - 2.5*pow({d},2) + 1 WHEN {d} < 2 THEN -0.5*pow({d},3) + 2.5*pow({d},2) - 4*{d} + 2 ELSE 0 END",
    "cubicspline": "CASE WHEN {d} < 1 THEN (4 - 6*pow({d},2) + 3*pow({d},3))/6 WHEN {d} < 2 THEN pow(2-{d},3)/6 ELSE 0 END",
    "lanczos": "CASE WHEN {d} = 0 THEN 1 WHEN {d} < 3 THEN 3*sin(pi()*{d})*sin(pi()*{d}/3)/pow(pi()*{d},2) ELSE 0 END",
}


def _kernel_sql(m):
    n = G.REACH[m]
    w = " * ".join(f"({_KERNEL[m].format(d=d)})" for d in _D)
    near = f"s.px_row BETWEEN floor(sy) - {n - 1} AND floor(sy) + {n} AND s.px_col BETWEEN floor(sx) - {n - 1} AND floor(sx) + {n}"
    total = f"sum(CASE WHEN s.b4 IS NOT NULL THEN {w} END)"
    return f"SELECT t.px_row, t.px_col, CASE WHEN {total} >= 0.1 THEN round(sum(CASE WHEN s.b4 IS NOT NULL THEN {w} * s.b4 END) / {total}, 4) END AS b4 FROM ({_COORDS}) t LEFT JOIN scene s ON {near} GROUP BY 1, 2"


_INSIDE_COARSE = "SELECT floor(((px_row + 0.5) * 10 - 4) / 40)::BIGINT AS px_row, floor(((px_col + 0.5) * 10 - 3) / 40)::BIGINT AS px_col, b4 FROM scene WHERE b4 IS NOT NULL"
ORACLES = {
    "g01_pixel_xy": oracle("SELECT px_row, px_col, 500000 + (px_col + 0.5) * 10.0::DOUBLE AS x, 7000000 - (px_row + 0.5) * 10.0::DOUBLE AS y, px_row AS back_row, px_col AS back_col FROM scene", "scene"),
    "g02_bounds": oracle("SELECT tile_id, 500000 + min(px_col) * 10.0::DOUBLE AS xmin, 7000000 - (max(px_row) + 1) * 10.0::DOUBLE AS ymin, 500000 + (max(px_col) + 1) * 10.0::DOUBLE AS xmax, 7000000 - min(px_row) * 10.0::DOUBLE AS ymax FROM scene_px GROUP BY tile_id", "scene_px"),
    "g02_extent": oracle("SELECT 500000 + min(px_col) * 10.0::DOUBLE AS xmin, 7000000 - (max(px_row) + 1) * 10.0::DOUBLE AS ymin, 500000 + (max(px_col) + 1) * 10.0::DOUBLE AS xmax, 7000000 - min(px_row) * 10.0::DOUBLE AS ymax FROM scene_px", "scene_px"),
    "g03_chip_bounds": oracle("SELECT DISTINCT px_row // 32 AS chip_row, px_col // 32 AS chip_col, 500000 + (px_col // 32) * 320.0::DOUBLE AS xmin, 7000000 - (px_row // 32 + 1) * 320.0::DOUBLE AS ymin, 500000 + (px_col // 32 + 1) * 320.0::DOUBLE AS xmax, 7000000 - (px_row // 32) * 320.0::DOUBLE AS ymax, 500160 + (px_col // 32) * 320.0::DOUBLE AS center_x, 6999840 - (px_row // 32) * 320.0::DOUBLE AS center_y FROM scene", "scene"),
    "g04_grid_check": oracle("SELECT DISTINCT tile_id, tile_id % 2 = 0 AS transform, tile_id % 2 = 0 AND tile_id <> 2 AS shape, tile_id <> 2 AS tolerance, tile_id <> 2 AS signature FROM scene_px", "scene_px"),
    "g05_overlap": oracle("SELECT poly_id, xmin, ymin, xmax, ymax, hit AS overlaps, xmin >= 60 AND ymin >= 50 AND xmax <= 190 AND ymax <= 170 AS contained, CASE WHEN hit THEN greatest(xmin, 60) END AS common_xmin, CASE WHEN hit THEN greatest(ymin, 50) END AS common_ymin, CASE WHEN hit THEN least(xmax, 190) END AS common_xmax, CASE WHEN hit THEN least(ymax, 170) END AS common_ymax FROM (SELECT poly_id, x0 AS xmin, y0 AS ymin, x0 + w AS xmax, y0 + w AS ymax, x0 < 190 AND x0 + w > 60 AND y0 < 170 AND y0 + w > 50 AS hit FROM label_polys)", "label_polys"),
    "g06_north_up": oracle("SELECT 255 - px_row AS px_row, px_col, b1 FROM scene", "scene"),
    "g07_align_nearest": oracle("SELECT t.px_row, t.px_col, coalesce(s.b4, -9999) AS b4 FROM (SELECT r.i AS px_row, c.i AS px_col FROM range(320) r(i) CROSS JOIN range(320) c(i)) t LEFT JOIN scene s ON s.px_row = floor((t.px_row + 0.5) * 0.8)::BIGINT AND s.px_col = floor((t.px_col + 0.5) * 0.8)::BIGINT", "scene"),
    "g09_resample_nearest": oracle(f"SELECT t.px_row, t.px_col, round(s.b4, 4) AS b4 FROM ({_COORDS}) t LEFT JOIN scene s ON s.px_row = floor(sy + 0.5)::BIGINT AND s.px_col = floor(sx + 0.5)::BIGINT", "scene"),
    "g09_resample_average": oracle(f"SELECT t.px_row, t.px_col, round(avg(s.b4), 4) AS b4 FROM ({_CELLS}) t LEFT JOIN ({_INSIDE_COARSE}) s USING (px_row, px_col) GROUP BY 1, 2", "scene"),
    "g09_resample_mode": oracle(f"SELECT t.px_row, t.px_col, round(m.b4, 4) AS b4 FROM ({_CELLS}) t LEFT JOIN (SELECT px_row, px_col, b4, row_number() OVER (PARTITION BY px_row, px_col ORDER BY count(*) DESC, b4) AS rn FROM ({_INSIDE_COARSE}) GROUP BY 1, 2, 3) m ON m.px_row = t.px_row AND m.px_col = t.px_col AND rn = 1", "scene"),
    "g10_snap_extent": oracle("SELECT poly_id, floor(x0/10)*10 AS xmin, floor(y0/10)*10 AS ymin, ceil((x0+w)/10)*10 AS xmax, ceil((y0+w)/10)*10 AS ymax FROM label_polys", "label_polys"),
    "g11_mosaic_resolution": oracle("SELECT 10.0::DOUBLE AS res, 10.0::DOUBLE AS res_y FROM (SELECT count(*) FROM scene_px)", "scene_px"),
    "g13_clip_rect": oracle("SELECT px_row - 40 AS px_row, px_col - 60 AS px_col, b1 FROM scene WHERE px_row BETWEEN 40 AND 139 AND px_col BETWEEN 60 AND 179", "scene"),
    "g14_clip_by_key": oracle(f"SELECT basin, px_row, px_col, l_orderkey, l_linenumber, b1 FROM (SELECT l_suppkey AS basin, *, {_XY} FROM scene_px) JOIN (SELECT *, CASE WHEN poly_id % 10 = 3 THEN poly_id - 1 ELSE poly_id END AS basin, count(*) OVER (PARTITION BY CASE WHEN poly_id % 10 = 3 THEN poly_id - 1 ELSE poly_id END) AS n FROM label_polys) USING (basin) WHERE n = 1 AND {_IN}", "scene_px", "label_polys"),
    "g15_rasterize": oracle(f"SELECT g.px_row, g.px_col, coalesce(max_by(CASE cls WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, poly_id), 0) AS label FROM (SELECT px_row, px_col, {_XY} FROM land_mask) g LEFT JOIN (SELECT * FROM label_polys WHERE cls IS NOT NULL) ON {_IN} GROUP BY 1, 2", "land_mask", "label_polys"),
    "g16_tile_hits": oracle("SELECT DISTINCT r.i AS chip_row, c.i AS chip_col FROM range(8) r(i), range(8) c(i), label_polys WHERE r.i * 32 + 32 >= y0 AND c.i * 32 + 32 >= x0 AND CASE WHEN shape = 'box' THEN r.i * 32 <= y0 + w AND c.i * 32 <= x0 + w ELSE greatest(r.i * 32 - y0, 0) + greatest(c.i * 32 - x0, 0) <= w END", "label_polys"),
    "g17_erase_buffer": oracle(f"SELECT px_row, px_col, CASE WHEN NOT EXISTS (SELECT 1 FROM label_polys WHERE ({_IN}) OR CASE WHEN shape = 'box' THEN {_NEAR['box']} ELSE {_NEAR['triangle']} END) THEN b1 END AS b1 FROM (SELECT px_row, px_col, b1, {_XY} FROM scene)", "scene", "label_polys"),
    "d07_join_polygons": oracle(f"SELECT px_row, px_col, poly_id FROM (SELECT px_row, px_col, {_XY} FROM scene) JOIN label_polys ON {_IN}", "scene", "label_polys"),
    "s02_blocks": oracle("SELECT px_row // 100 AS block_row, px_col // 100 AS block_col, count(*) AS n, arg_min(b1, px_row * 1000 + px_col) AS first_b1, arg_max(b1, px_row * 1000 + px_col) AS last_b1 FROM scene GROUP BY 1, 2", "scene"),
    "s02_pixels": oracle("SELECT px_row, px_col, b1 FROM scene", "scene"),
} | {f"g09_resample_{m}": oracle(_kernel_sql(m), "scene") for m in G.REACH}
