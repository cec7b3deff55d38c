"""Pixels stored by block in buckets: joins and aggregations by pixel or block then need no exchange.

A table of blocks is bucketed by (block_row, block_col). Rasters stored with one block size and one number of buckets
line up, so stacking any number of them, masking, mosaics and counts by chip (a chip being a whole part of a block)
read each bucket once where it lies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import scratch

BLOCK = ("block_row", "block_col")
#: The keys to join stored rasters on.
KEYS = (*BLOCK, "px_row", "px_col")


def co_located(spark: SparkSession) -> None:
    """Let this session join on the bucket columns and more without an exchange: by default joins want all their keys bucketed."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def buckets_for(rows: int, each: int = 1 << 22) -> int:
    """Buckets for rasters of about so many pixels: a power of two, so that other sizes divide it."""
    return 1 << max(3, math.ceil(math.log2(max(rows, 1) / each)) if rows > each else 3)


def store_blocks(px: DataFrame, name: str, size: int, buckets: int) -> DataFrame:
    """Store pixels (px_row, px_col, ...) by blocks of size x size, one file a bucket, and read them back with block_row and block_col.

    A row without a place is left out: it is in no block.
    """
    spark, path = px.sparkSession, scratch(px.sparkSession, name)
    at = {b: F.floor(F.col(c) / size).cast("int") for b, c in zip(BLOCK, ("px_row", "px_col"))}
    rows = px.where("px_row IS NOT NULL AND px_col IS NOT NULL").withColumns(at).repartition(buckets, *BLOCK)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    rows.write.bucketBy(buckets, *BLOCK).option("path", path).saveAsTable(table)
    return spark.table(table)
