"""Row numbers in a total order, from sorted range partitions and the prefix sums of their counts.

A window without a partition would sort all rows in one task; here each range partition is sorted on its own, and
only its count, one number a partition, goes through the driver. Rows that tie in the whole order are numbered in
some order; nulls sort as the order says.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch

_AT = "_order_at"


def numbered_in_order(df: DataFrame, order: list[Column], name: str = "rank", first: int = 1) -> DataFrame:
    """Add ``name``, counting from ``first`` in the order given. The rows are stored, so the numbers stay the same.

    An empty input gives an empty result. Rows with one value of all sort columns share a range partition: give
    a last column that tells rows apart where very many may tie.
    """
    spark = df.sparkSession
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id())
    path = scratch(spark, "ordered")
    sorted_rows.write.parquet(path)
    stored = spark.read.schema(sorted_rows.schema).parquet(path)
    part, place = F.shiftright(_AT, 33), F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1))
    counts = dict(stored.groupBy(part.alias("p")).count().collect())
    before = np.zeros(max(counts, default=0) + 2, np.int64)
    for p, n in counts.items():
        before[p + 1] = n
    before = F.lit(np.cumsum(before))
    return stored.withColumn(name, F.get(before, part.cast("int")) + place + F.lit(first).cast("long")).drop(_AT)
