"""Tiles that arrive as files, each masked once; a restart goes on from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], files: int = 1000) -> StreamingQuery:
    """Apply ``step`` to every Parquet file below ``source`` not seen before, append to ``target``, and stop.

    The file sink's log makes each batch appear once, also after a failure. An empty folder gives no rows.
    """
    px = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    out = step(px).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()
