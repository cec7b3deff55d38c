from pyspark.sql import functions as F

from gridloom.operators.mask import is_artefact
from gridloom.sources import files
from gridloom.streaming.ingest import ingest_stream


def test_discover_prefers_an_extension(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.tif", "a.tiff", "sub/b.tiff", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = {r["name"]: r["path"].rsplit("/", 1)[1] for r in files.discover(spark, str(tmp_path)).collect()}
    assert found == {"a": "a.tif", "b": "b.tiff"}


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    px = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 65535.0), (3, None)], "px int, b1 double")
    step = lambda df: df.withColumn("b1", F.when(~is_artefact("b1"), F.col("b1")))
    for n in (1, 2, 2):
        if n * 4 > (spark.read.parquet(source).count() if (tmp_path / "in").exists() else 0):
            px.coalesce(1).write.mode("append").parquet(source)
        ingest_stream(spark, source, "px int, b1 double", target, log, step).awaitTermination(120)
        out = spark.read.parquet(target)
        assert (out.count(), out.where("b1 IS NOT NULL").count()) == (4 * n, n)
