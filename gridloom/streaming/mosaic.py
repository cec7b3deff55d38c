"""A mosaic that takes tiles as they come, and rewrites only the blocks that they touch.

Below ``target``, data/version=<batch> has whole blocks and blocks/batch=<batch> names them, written after the
data; a block's rows are those of its latest version. Nothing is changed in place: a batch that failed half way is
written again under its own name, and since the last source of a pixel wins whatever comes when, taking a tile
twice changes nothing. Pixels of a tile whose file is gone since stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mosaic import mosaic_last
from ..sources.layout import BLOCK


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_mosaic(spark: SparkSession, target: str, schema: str, before: int | None = None) -> DataFrame:
    """The mosaic's rows (order columns included), of batches before a given one or of all; no rows before the first batch."""
    stored = f"version long, block_row int, block_col int, {schema}"
    if not _exists(spark, f"{target}/blocks"):
        return spark.createDataFrame([], stored).drop("version", *BLOCK)
    named = spark.read.schema("batch long, block_row int, block_col int").parquet(f"{target}/blocks")
    if before is not None:
        named = named.where(F.col("batch") < before)
    latest = named.groupBy(*BLOCK).agg(F.max("batch").alias("version"))
    data = spark.read.schema(stored).parquet(f"{target}/data")
    return data.join(latest, ["version", *BLOCK], "left_semi").drop("version", *BLOCK)


def merge_tiles(spark: SparkSession, tiles: DataFrame, target: str, batch: int, schema: str, order: list[str], values: list[str], size: int, valid: str) -> None:
    """Write new versions of the blocks that the tiles' pixels with a value touch."""
    at = {b: F.floor(F.col(c) / size).cast("int") for b, c in zip(BLOCK, ("px_row", "px_col"))}
    new = tiles.where(F.col(valid).isNotNull()).withColumns(at)
    touched = new.select(*BLOCK).distinct()
    touched.write.mode("overwrite").parquet(staged := f"{target}/touched/batch={batch}")
    touched = spark.read.schema("block_row int, block_col int").parquet(staged)
    old = read_mosaic(spark, target, schema, batch).withColumns(at).join(touched, list(BLOCK), "left_semi")
    kept = list(dict.fromkeys([*values, *order]))
    merged = mosaic_last(new.select(*BLOCK, "px_row", "px_col", *kept).unionByName(old.select(*BLOCK, "px_row", "px_col", *kept)), order, kept, (*BLOCK, "px_row", "px_col"), valid)
    merged.repartition(*BLOCK).write.mode("overwrite").partitionBy(*BLOCK).parquet(f"{target}/data/version={batch}")
    touched.write.mode("overwrite").parquet(f"{target}/blocks/batch={batch}")


def mosaic_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, order: list[str], values: list[str], size: int = 256, valid: str = "b1", files: int = 1000) -> StreamingQuery:
    """Merge every Parquet file of tile pixels below ``source`` not seen before into the mosaic below ``target``, and stop.

    ``schema`` has px_row, px_col, ``values`` and ``order``; ``order`` must be a full key. The merged rows are
    shuffled by block, so a batch costs what the blocks it touches hold, not what the mosaic holds.
    """
    px = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def step(tiles: DataFrame, batch: int) -> None:
        merge_tiles(tiles.sparkSession, tiles, target, batch, schema, order, values, size, valid)

    return px.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
