"""Times the headline queries and prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from gridloom import catalog

NAMES = ["m09_snow_stats", "m08_apply_mask", "d01_mosaic_last", "i_indices", "m23_dequantize", "g12_overview", "n02_band_stats", "g15_rasterize", "l09_chip_metadata", "p05_blend", "p05_predict_blocks", "u02_entropy", "g16_tile_hits", "g08_reproject", "g08_reproject_blocks", "c04_kfold"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.local.dir", scratch)
    spark = spark.config("spark.checkpoint.dir", f"{scratch}/shared").config("spark.sql.warehouse.dir", f"{scratch}/warehouse").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(3):
            start = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        took[name] = round(sorted(runs)[1], 3)
    print(json.dumps({"metric": "headline queries, median of 3", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
