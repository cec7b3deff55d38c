"""Queries on rasters stored by blocks, on a mosaic that grows by tiles, and on counts taken while writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chips as L
from ..operators import mask as M
from ..operators import mosaic as D
from ..sources import files as S
from ..sources import layout as B
from ..sources.views import land_mask, oracle, scene, scene_px
from ..streaming.mosaic import mosaic_stream, read_mosaic
from .masks import _ART, SNOW_SQL, snow_px
from .stats import clean
from .training import ORDER

SIZE = 64
BANDS3 = ("b2", "b4", "b7")


def _stored(spark, px, name):
    return B.store_blocks(px, name, SIZE, B.buckets_for(1 << 16))


def d05_stack_stored(spark, sf_dir):
    """Three rasters of one band, each without its own artefacts, stacked where all have a value."""
    B.co_located(spark)
    px = clean(spark, sf_dir)
    rasters = [_stored(spark, px.select("px_row", "px_col", b).where(F.col(b).isNotNull()), f"raster-{b}") for b in BANDS3]
    return L.stack_rasters(rasters, B.KEYS).select("px_row", "px_col", *BANDS3)


def d06_mask_stored(spark, sf_dir):
    """The scene's pixels with the land mask, and the count of land pixels by block."""
    B.co_located(spark)
    px = _stored(spark, scene(spark, sf_dir).select("px_row", "px_col", "b1"), "scene")
    mask = _stored(spark, land_mask(spark), "mask")
    joined = px.join(mask, list(B.KEYS)).withColumn("land", M.land_isclose("mask", -9999.0))
    return joined.groupBy(*B.BLOCK).agg(F.count("*").alias("n"), F.count_if("land").alias("n_land"))


def d01_mosaic_stored(spark, sf_dir):
    px = _stored(spark, scene_px(spark, sf_dir), "tiles")
    return D.mosaic_last(px, ["tile_id", *ORDER], ["tile_id", *M.BANDS], B.KEYS).drop(*B.BLOCK)


def s15_mosaic_stream(spark, sf_dir):
    """The scene's mosaic, from tiles that come as files, one or more a batch."""
    source, target, log = (S.scratch(spark, n) for n in ("tiles", "mosaic", "stream"))
    px = scene_px(spark, sf_dir).select("px_row", "px_col", "tile_id", *ORDER, *M.BANDS)
    px.repartition("tile_id").write.parquet(source)
    schema = ", ".join(f"{c} {t}" for c, t in px.dtypes)
    mosaic_stream(spark, source, schema, target, log, ["tile_id", *ORDER], list(M.BANDS), SIZE, files=1).awaitTermination()
    return read_mosaic(spark, target, schema).select("tile_id", "px_row", "px_col", *M.BANDS)


def s13_write_observed(spark, sf_dir):
    """Masked pixels written, with their counts taken on the way."""
    px = M.apply_mask(snow_px(spark, sf_dir))
    counts = {"n": F.count("*"), "n_land": F.count_if("land"), "n_snow": F.count_if("snow"), "n_secondary": F.count_if("snow_secondary"), "n_b1": F.count("b1"), "n_b2": F.count("b2")}
    return S.write_observed(px, S.scratch(spark, "masked"), counts)


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0] in "ds" and k[1:3].isdigit()}

_OK = "NOT ({0} = 0 OR {0} >= 60000)"
ORACLES = {
    "d05_stack_stored": oracle("SELECT px_row, px_col, b2, b4, b7 FROM scene WHERE " + " AND ".join(_OK.format(b) for b in BANDS3), "scene"),
    "d06_mask_stored": oracle("SELECT px_row // 64 AS block_row, px_col // 64 AS block_col, count(*) AS n, count(*) FILTER (mask <> -9999) AS n_land FROM scene JOIN land_mask USING (px_row, px_col) GROUP BY 1, 2", "scene", "land_mask"),
    "d01_mosaic_stored": oracle("SELECT * FROM scene", "scene"),
    "s15_mosaic_stream": oracle("SELECT * FROM scene", "scene"),
    "s13_write_observed": oracle(SNOW_SQL + f"SELECT count(*) AS n, count(*) FILTER (land) AS n_land, count(*) FILTER (snow) AS n_snow, count(*) FILTER (snow_secondary) AS n_secondary, count(*) FILTER (land AND NOT snow AND NOT {_ART.format('b1')}) AS n_b1, count(*) FILTER (land AND NOT snow AND NOT {_ART.format('b2')}) AS n_b2 FROM px", "scene_px", "land_mask"),
}
