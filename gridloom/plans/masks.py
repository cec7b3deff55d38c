"""Queries on masks, snow and nodata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mask as M
from ..sources.views import land_mask, oracle, scene_px

_LAND = "abs(mask + 9999) > 1e-8 + 1e-5 * 9999"
_ART = "({0} = 0 OR {0} >= 60000)"
_NDSI = "(b2 - b9) / nullif(b2 + b9, 0) > 0.4"
SNOW_SQL = f"""WITH land AS (SELECT s.*, {_LAND} AS land FROM scene_px s JOIN land_mask USING (px_row, px_col)),
p AS (SELECT *, land AND NOT {_ART.format('b2')} AND NOT {_ART.format('b9')} AND coalesce({_NDSI}, false) AS snow_primary,
 land AND NOT {_ART.format('b1')} AND NOT {_ART.format('b2')} AND NOT {_ART.format('b3')} AND NOT {_ART.format('b7')} AND NOT {_ART.format('b9')}
  AND (b2 - b9) >= 0.42 * (b2 + b9) AND (b7 - b3) <= 0.15 * (b7 + b3) AND (b1 + b2 + b3) / 3 >= 1800 AND b9 <= 2200 AS snow_secondary FROM land),
px AS (SELECT *, snow_primary OR snow_secondary AS snow FROM p)
"""


def snow_px(spark, sf_dir):
    """Scene pixels with land and snow: the mask is joined on the pixel."""
    px = scene_px(spark, sf_dir).join(land_mask(spark), ["px_row", "px_col"])
    return M.with_snow(px.withColumn("land", M.land_isclose("mask", -9999.0)))


def m09_snow_stats(spark, sf_dir):
    return M.snow_stats(snow_px(spark, sf_dir))


QUERIES = {"m09_snow_stats": m09_snow_stats}
ORACLES = {
    "m09_snow_stats": oracle(
        SNOW_SQL + f"""SELECT tile_id, n_primary, n_secondary, n_secondary_only, n_snow, n_land, n_valid,
 round(CASE WHEN n_land > 0 THEN 100.0 * n_snow / n_land ELSE 0 END, 6) AS pct_of_land,
 round(CASE WHEN n_valid + n_snow > 0 THEN 100.0 * n_snow / (n_valid + n_snow) ELSE 0 END, 6) AS pct_of_valid
 FROM (SELECT tile_id, count(*) FILTER (WHERE snow_primary) AS n_primary, count(*) FILTER (WHERE snow_secondary) AS n_secondary,
 count(*) FILTER (WHERE snow_secondary AND NOT snow_primary) AS n_secondary_only, count(*) FILTER (WHERE snow) AS n_snow,
 count(*) FILTER (WHERE land) AS n_land, count(*) FILTER (WHERE land AND NOT snow AND NOT {_ART.format('b1')}) AS n_valid
 FROM px GROUP BY tile_id) t""",
        "scene_px",
        "land_mask",
    )
}
