"""Mosaics and summaries of pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mosaic_last(px: DataFrame, order: list[str], values: list[str], keys=("px_row", "px_col"), valid: str = "b1") -> DataFrame:
    """The last source of each pixel by ``order``; a pixel without a value doesn't cover one below it.

    One aggregation with a partial step before the shuffle; ``order`` must be a full key for a repeatable result.
    """
    best = px.where(F.col(valid).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return best.select(*keys, *[F.col("_v")[v].alias(v) for v in values])


def mosaic_by(px: DataFrame, by: str, order: list[str], values: list[str], valid: str = "b1") -> DataFrame:
    """A last-wins mosaic for each variable or folder, all in one aggregation."""
    return mosaic_last(px, order, values, (by, "px_row", "px_col"), valid)


def stack(px: DataFrame, source: str, sources: list, value: str, separate: bool = True, keys=("px_row", "px_col")) -> DataFrame:
    """One band a source (``v_<source>``, NULL where it has no pixel), or all sources' pixels below each other.

    The list of sources is given, so that no job looks for them. Of several values of a source at a pixel the largest stays.
    """
    if not separate:
        return px.where(F.col(source).isin(*sources)).select(*keys, source, value)
    return px.groupBy(*keys).agg(*[F.max(F.when(F.col(source) == s, F.col(value))).alias(f"v_{s}") for s in sources])


def overview(px: DataFrame, level: int, bands: list[str]) -> DataFrame:
    """Averages over squares of 2^level pixels."""
    size = 1 << level
    at = [F.floor(F.col(k) / size).cast("bigint").alias(k) for k in ("px_row", "px_col")]
    return px.groupBy(*at).agg(*[F.avg(b).alias(b) for b in bands])


def value_counts(px: DataFrame, v: str) -> DataFrame:
    """Count and percentage of each value; the window runs over the counts only."""
    n = px.groupBy(v).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))
