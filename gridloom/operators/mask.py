"""Masks, artefacts, snow, rules and nodata: projections and filters over pixel tables.

Nodata is NULL after the scan; a boolean mask is never NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = tuple(f"b{i}" for i in range(1, 11))


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def true(cond: Column) -> Column:
    """The condition with NULL as false."""
    return F.coalesce(cond, F.lit(False))


@dataclass(frozen=True)
class SnowParams:
    """Band names and thresholds of the snow tests."""

    blue: str = "b1"
    green: str = "b2"
    red: str = "b3"
    nir: str = "b7"
    swir: str = "b9"
    ndsi: float = 0.4
    strong: float = 0.42
    flat: float = 0.15
    bright: float = 1800.0
    dark: float = 2200.0
    saturated: float = 60000.0


def land_isclose(v, nodata: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """M1: true on land, where the mask is not nodata within a relative tolerance."""
    return true(F.abs(col(v) - nodata) > atol + rtol * abs(nodata))


def land_valid(v, nodata: float | None = None) -> Column:
    """M2: true where the mask has a value other than nodata."""
    return col(v).isNotNull() if nodata is None else true(col(v) != nodata)


def mask_gt(v, threshold: float = 0.0) -> Column:
    """M3: true where the mask is finite and over the threshold."""
    return true(col(v) > threshold)


def is_artefact(v, saturated: float = 60000.0) -> Column:
    """M4: true for 0 and for saturated values."""
    return true((col(v) == 0) | (col(v) >= saturated))


def ndsi(green, swir) -> Column:
    """(G - S) / (G + S), NULL where the sum is 0."""
    g, s = col(green), col(swir)
    return F.when(g + s != 0, (g - s) / (g + s))


def snow_primary(land: Column, p: SnowParams = SnowParams()) -> Column:
    """M5: land, no artefact in green or SWIR, and NDSI over the threshold."""
    clean = ~is_artefact(p.green, p.saturated) & ~is_artefact(p.swir, p.saturated)
    return land & clean & true(ndsi(p.green, p.swir) > p.ndsi)


def snow_secondary(land: Column, p: SnowParams = SnowParams()) -> Column:
    """M6: the ratio-free test on five bands, all clean: bright in the visible, dark in SWIR, flat to NIR."""
    b, g, r, n, s = (F.col(x) for x in (p.blue, p.green, p.red, p.nir, p.swir))
    clean = land
    for x in (p.blue, p.green, p.red, p.nir, p.swir):
        clean = clean & ~is_artefact(x, p.saturated)
    return clean & true(((g - s) >= p.strong * (g + s)) & ((n - r) <= p.flat * (n + r)) & ((b + g + r) / 3 >= p.bright) & (s <= p.dark))


def snow_legacy(p: SnowParams = SnowParams()) -> Column:
    """M7: NDSI over the threshold, gated by neither land nor artefacts."""
    return true(ndsi(p.green, p.swir) > p.ndsi)


def apply_mask(px: DataFrame, land: str = "land", snow: str = "snow", bands=BANDS, saturated: float = 60000.0) -> DataFrame:
    """M8: each band keeps its value on land without snow or an artefact of its own, else NULL."""
    return px.withColumns({b: F.when(F.col(land) & ~F.col(snow) & ~is_artefact(b, saturated), F.col(b)) for b in bands})


def with_snow(px: DataFrame, p: SnowParams = SnowParams(), land: str = "land") -> DataFrame:
    """Add snow_primary, snow_secondary and snow (either)."""
    px = px.withColumns({"snow_primary": snow_primary(F.col(land), p), "snow_secondary": snow_secondary(F.col(land), p)})
    return px.withColumn("snow", F.col("snow_primary") | F.col("snow_secondary"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where there is nothing."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def snow_stats(px: DataFrame, by: str = "tile_id", first_band: str = "b1", saturated: float = 60000.0) -> DataFrame:
    """M9: snow summary of each tile from the columns land, snow_primary, snow_secondary and snow."""
    valid = F.col("land") & ~is_artefact(first_band, saturated) & ~F.col("snow") & F.col(first_band).isNotNull()
    n = lambda c: F.count_if(c)
    out = px.groupBy(by).agg(
        n(F.col("snow_primary")).alias("n_primary"),
        n(F.col("snow_secondary")).alias("n_secondary"),
        n(F.col("snow_secondary") & ~F.col("snow_primary")).alias("n_secondary_only"),
        n(F.col("snow")).alias("n_snow"),
        n(F.col("land")).alias("n_land"),
        n(valid).alias("n_valid"),
    )
    return out.withColumns({"pct_of_land": F.round(percent(F.col("n_snow"), F.col("n_land")), 6), "pct_of_valid": F.round(percent(F.col("n_snow"), F.col("n_valid") + F.col("n_snow")), 6)})


def null_above(px: DataFrame, rules: DataFrame, raster: str = "raster_id", v: str = "v", default: float = 1e14) -> DataFrame:
    """NULL above the threshold of the first rule (by ord) whose key is in the raster's name.

    ``rules`` is (ord, key, upper); it is matched to the distinct raster names first, a small table.
    """
    names = px.select(raster).distinct()
    best = names.join(rules, F.col(raster).contains(F.col("key"))).groupBy(raster).agg(F.min_by("upper", "ord").alias("_upper"))
    joined = px.join(best, raster, "left")
    return joined.withColumn(v, F.when(F.col(v) <= F.coalesce("_upper", F.lit(default)), F.col(v))).drop("_upper")


def null_outside(px: DataFrame, rules: DataFrame, raster: str = "raster_id", v: str = "v") -> DataFrame:
    """NULL below the lower or above the upper bound of the first rule that fits; other rasters are kept; adds bad."""
    names = px.select(raster).distinct()
    best = names.join(rules, F.col(raster).contains(F.col("key"))).groupBy(raster).agg(F.min_by(F.struct("lower", "upper"), "ord").alias("_b"))
    joined = px.join(best, raster, "left")
    bad = true((F.col(v) < F.col("_b.lower")) | (F.col(v) > F.col("_b.upper")))
    return joined.withColumn("bad", bad).withColumn(v, F.when(~F.col("bad"), F.col(v))).drop("_b")


def flag_bad(px: DataFrame, raster: str = "raster_id") -> DataFrame:
    """Whether a raster has any bad pixel, from the column bad of the unmasked raster."""
    return px.groupBy(raster).agg(F.bool_or("bad").alias("is_bad"))


def quick_bad(px: DataFrame, limit: float = 1e15, raster: str = "raster_id", v: str = "v") -> DataFrame:
    """Whether a raster's extremes pass the limit; unknown counts as bad."""
    return px.groupBy(raster).agg(F.coalesce((F.max(v) > limit) | (F.min(v) < -limit), F.lit(True)).alias("is_bad"))


def null_extreme(v, limit: float = 1e15, two_sided: bool = True) -> Column:
    """NULL beyond the limit."""
    x = col(v)
    return F.when((F.abs(x) if two_sided else x) <= limit, x)


def extract_by_mask(px: DataFrame, mask: DataFrame, keys=("px_row", "px_col")) -> DataFrame:
    """Pixels under the mask."""
    return px.join(mask.select(*keys), list(keys), "left_semi")


def erase_by_mask(px: DataFrame, mask: DataFrame, keys=("px_row", "px_col")) -> DataFrame:
    """Pixels that the mask doesn't cover."""
    return px.join(mask.select(*keys), list(keys), "left_anti")


def null_value(v, value: float = -1.0) -> Column:
    """NULL for one value."""
    return F.nullif(col(v), F.lit(value))


def null_below(v, bound: float = -500.0) -> Column:
    """NULL below a bound."""
    return F.when(col(v) >= bound, col(v))


def normalize_nodata(v, nodata: float | None) -> Column:
    """NULL for nodata and for 0."""
    x = col(v) if nodata is None else F.nullif(col(v), F.lit(nodata))
    return F.nullif(x, F.lit(0.0))


def fill_nodata(v, value: float = -9999.0) -> Column:
    """The sink's nodata value for NULL."""
    return F.coalesce(col(v), F.lit(value))


def orient_mask(mask: DataFrame, v: str = "mask") -> DataFrame:
    """Invert a 0/1 mask unless it has more ones than zeros."""
    ones, zeros = F.count_if(F.col(v) == 1), F.count_if(F.col(v) == 0)
    turn = mask.agg((ones <= zeros).alias("_turn"))
    return mask.crossJoin(F.broadcast(turn)).withColumn(v, F.when(F.col("_turn"), 1 - F.col(v)).otherwise(F.col(v))).drop("_turn")


def mul_mask(px: DataFrame, mask: DataFrame, bands=BANDS, keys=("px_row", "px_col")) -> DataFrame:
    """Every band times the mask (column mask), 0 being nodata."""
    return px.join(mask.select(*keys, "mask"), list(keys)).withColumns({b: F.col(b) * F.col("mask") for b in bands}).drop("mask")


def dequantize(q) -> Column:
    """(q / 127.5)^2 with q's sign."""
    x = col(q) / F.lit(127.5)
    return x * x * F.signum(col(q).cast("double"))


def all_null_tiles(px: DataFrame, by: str = "tile_id", v: str = "b1") -> DataFrame:
    """Tiles without any value."""
    return px.groupBy(by).agg((F.count(v) == 0).alias("all_null"))


def safe_div(a, b, eps: float = 1e-8, limit: float = 1.0) -> Column:
    """A / (b + eps); NULL where the divisor is 0 or the result is beyond the limit."""
    r = F.try_divide(col(a), col(b) + F.lit(eps))
    return F.when(F.abs(r) <= limit, r)


def index(a: str, b: str) -> Column:
    """(a - b) / (a + b) by safe_div, of raw bands."""
    return safe_div(F.col(a) - F.col(b), F.col(a) + F.col(b))


#: Bands of each index in the masking band table.
INDICES = {"ndvi": ("b7", "b3"), "ndwi": ("b2", "b7"), "ndmi": ("b7", "b9"), "ndsi": ("b2", "b9"), "nbr": ("b7", "b10")}
