"""Raster catalogs and runs: names, paths, pairs, pending work and reports. A catalog is a table, never a directory listing on the driver."""

from __future__ import annotations

import io
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: First bytes of raster files and what they tell: byte order, and whether offsets have 64 bits.
TIFF_HEADS = {b"II*\0": ("<", False), b"MM\0*": (">", False), b"II+\0": ("<", True), b"MM\0+": (">", True)}
#: Numbers of the tags that a probe looks for, and of the types that their values may have.
TIFF_TAGS = {256: "width", 257: "height", 277: "bands"}
TIFF_TYPES = {3: "H", 4: "I", 16: "Q"}
_PROBE = "path string, length long, modificationTime timestamp, name string, rank int, status string, width long, height long, bands long"


def discover(spark: SparkSession, root: str, exts=("tif", "tiff"), names: list[str] | None = None, probe: bool = False) -> DataFrame:
    """S3: path, name, length and time of raster files below a folder, the preferred extension first where a name has several.

    ``names`` asks for some names only (without extension, case counts); one without a file has a null path. With
    ``probe``, files whose head can be read come before others of their name, and status, width, height and bands
    are added: ok, not a raster, truncated (its directory is past the end), unreadable, or missing for an asked name;
    an empty file counts as missing, as the reader lists none. A probe runs in the tasks, a file at a time, and reads the head and the first directory only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(exts)}}}").load(root).select("path", "length", "modificationTime")
    base = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*map(F.lit, exts)), F.lower(F.substring_index(base, ".", -1))).cast("int")
    files = files.withColumns({"name": F.regexp_replace(base, r"\.[^.]*$", ""), "rank": rank})
    if names is not None:
        wanted = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
        files = files.join(wanted, "name", "left_semi")
    told = ["path", "length", "modificationTime"]
    order = [F.col("rank"), F.col("path")]
    if probe:
        files = files.select(*told, "name", "rank").repartition("path").mapInArrow(_probe, _PROBE)
        told += ["status", "width", "height", "bands"]
        order.insert(0, F.col("status") != "ok")
    found = files.groupBy("name").agg(F.min_by(F.struct(*told), F.struct(*order)).alias("_f")).select("name", "_f.*")
    if names is not None:
        found = wanted.join(found, "name", "left")
        if probe:
            found = found.withColumn("status", F.coalesce("status", F.lit("missing")))
    return found


def _probe(batches):
    """Rows of _PROBE for rows of its first five columns."""
    import pyarrow as pa

    for batch in batches:
        heads = [_tiff_head(x) for x in batch.column("path").to_pylist()]
        told = [pa.array([h.get(k) for h in heads], pa.string() if k == "status" else pa.int64()) for k in ("status", "width", "height", "bands")]
        yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[x.split()[0] for x in _PROBE.split(", ")])


def _tiff_head(path: str) -> dict:
    """Status, and size and bands where the file's first directory tells them (one band where it doesn't)."""
    import struct

    from pyarrow import fs

    try:
        local = re.fullmatch(r"(?:file:)?/+(.*)", path, re.S)
        store, at = (fs.LocalFileSystem(), f"/{local[1]}") if local else fs.FileSystem.from_uri(path)
        with store.open_input_file(at) as f:
            head = f.read(16)
            if head[:4] not in TIFF_HEADS:
                return {"status": "not a raster"}
            order, big = TIFF_HEADS[head[:4]]
            number, word, entry = ("Q", "Q", 20) if big else ("H", "I", 12)
            size, width = struct.calcsize(order + number), struct.calcsize(order + word)
            (start,) = struct.unpack_from(order + word, head, 8 if big else 4)
            f.seek(start)
            (n,) = struct.unpack(order + number, f.read(size))
            raw = f.read(n * entry)
    except struct.error:
        return {"status": "truncated"}
    except OSError:
        return {"status": "unreadable"}
    if len(raw) < n * entry or not n:
        return {"status": "truncated"}
    out = {"status": "ok", "bands": 1}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", raw, i * entry)
        if tag in TIFF_TAGS and kind in TIFF_TYPES:
            out[TIFF_TAGS[tag]] = struct.unpack_from(order + TIFF_TYPES[kind], raw, i * entry + 4 + width)[0]
    return out if "width" in out and "height" in out else {"status": "truncated"}


def split_predictors(catalog: DataFrame, mark: str = "sentinel") -> DataFrame:
    """Add is_main: true for the first path that holds the mark, or else the first of all."""
    first = catalog.agg(F.min_by("path", F.struct(~F.lower("path").contains(mark), F.col("path"))).alias("_main"))
    return catalog.crossJoin(F.broadcast(first)).withColumn("is_main", F.col("path") == F.col("_main")).drop("_main")


def rebase(path, folder: str) -> Column:
    """The file's name, of either kind of slash, below another folder."""
    name = F.element_at(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.concat(F.lit(folder.rstrip("/") + "/"), name)


def mount_drive(path, root: str = "/mnt") -> Column:
    """A drive path as a path below the folder of mounted drives."""
    slashed = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    return F.when(slashed.rlike("^[A-Za-z]:/"), F.concat(F.lit(root + "/"), F.lower(F.substring(slashed, 1, 1)), F.substring(slashed, 3, 1 << 20))).otherwise(slashed)


def output_name(stem, suffix: str) -> Column:
    """A stem that is safe in a file name, with a suffix."""
    return F.concat(F.lower(F.regexp_replace(F.col(stem), "[^A-Za-z0-9_]+", "_")), F.lit(suffix))


def pair_chips(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """Every name of either side with whether it has a partner."""
    a, b = x.select(key, F.lit(True).alias("has_x")), y.select(key, F.lit(True).alias("has_y"))
    out = a.join(b, key, "full_outer").select(key, F.coalesce("has_x", F.lit(False)).alias("has_x"), F.coalesce("has_y", F.lit(False)).alias("has_y"))
    return out.withColumn("paired", F.col("has_x") & F.col("has_y"))


def pending(inputs: DataFrame, outputs: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Inputs without an output, or all of them."""
    return inputs if overwrite else inputs.join(outputs.select(key), key, "left_anti")


def pending_zones(expected: DataFrame, outputs: DataFrame, zone: str, key: str) -> DataFrame:
    """Zones of which some expected output is missing."""
    seen = expected.join(outputs.select(key, F.lit(True).alias("_seen")).distinct(), key, "left")
    return seen.groupBy(zone).agg(F.bool_and(F.coalesce("_seen", F.lit(False))).alias("done")).where("NOT done").select(zone)


def run_report(items: DataFrame, zone: str, status: str = "status") -> DataFrame:
    """Items of each zone and status."""
    return items.groupBy(zone, status).agg(F.count("*").alias("n"))


def write_report(items: DataFrame, path: str) -> None:
    """One JSON object an item, with its status and whatever is told about it."""
    items.write.json(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    """The items of a report, or of several below a folder."""
    return spark.read.schema(schema).json(path)


def write_observed(px: DataFrame, path: str, counts: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Write ``px``, and return one row of ``counts`` (aggregates over its rows) that were taken while writing.

    The counts come with the write's own job, so the input is read once. A stage that Spark has to run again may
    count its rows again; where that matters, count the stored table.
    """
    watch = Observation()
    watched = px.observe(watch, *[c.alias(k) for k, c in counts.items()])
    writer = watched.write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return px.sparkSession.createDataFrame([tuple(watch.get[k] for k in counts)], px.limit(0).agg(*[c.alias(k) for k, c in counts.items()]).schema)


def write_raster(px: DataFrame, path: str, raster: str, block: int = 256) -> None:
    """Pixels stored by raster and by row of blocks, so that a scan of a window reads those files alone."""
    px.withColumn("block_row", F.floor(F.col("px_row") / block).cast("int")).write.partitionBy(raster, "block_row").parquet(path)


def scan(spark: SparkSession, path: str, raster: str, which, bands=None, window: tuple[int, int, int, int] | None = None, block: int = 256) -> DataFrame:
    """Pixels of one raster: all or some bands, all of it or a window (first row, first column, rows, columns).

    Bands become the columns that are read, the window's rows of blocks the partitions, and its bounds filters that
    Parquet gets. A window beyond the raster is cut to it; one of no rows or columns gives nothing.
    """
    px = spark.read.parquet(path).where(F.col(raster) == which)
    if window is not None:
        row, at, rows, columns = window
        px = px.where(F.col("block_row").between(row // block, (row + rows - 1) // block))
        px = px.where(F.col("px_row").between(row, row + rows - 1) & F.col("px_col").between(at, at + columns - 1))
    return px.drop("block_row") if bands is None else px.select(raster, "px_row", "px_col", *bands)


def select_band(px: DataFrame, band: str, keys=("px_row", "px_col")) -> DataFrame:
    """One band as v."""
    return px.select(*keys, F.col(band).alias("v"))


def split_good_bad(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that may go on and rows to set aside; an unknown verdict sets a row aside."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)


def mosaic_sources(catalog: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """D3: distinct sources that exist."""
    return catalog.select(key).distinct().join(existing.select(key), key, "left_semi")


def lookup(px: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """A value by key from a dimension table, with a default; the planner broadcasts the table if it is small."""
    return px.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet below the shared folder that the session names; a cluster must name one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_POINTS = "array<array<array<double>>>"


def write_polygons(polys: DataFrame, path: str, crs: str) -> None:
    """GeoJSON, one feature a line: the rings' points as coordinates, other columns as properties."""
    points = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), points.alias("coordinates"))
    named = F.struct(F.struct(F.lit(crs).alias("name")).alias("properties"))
    polys.select(F.lit("Feature").alias("type"), F.struct(*[c for c in polys.columns if c != "rings"]).alias("properties"), geometry.alias("geometry"), named.alias("crs")).write.json(path)


def read_polygons(spark: SparkSession, path: str, properties: str, crs: str) -> DataFrame:
    """Properties (given as a schema), rings and crs_ok of GeoJSON lines.

    Polygons and multipolygons are read; their rings are all in one list, as the even-odd rule needs. Another or
    no geometry, an unreadable line, and coordinates of fewer than two numbers give NULL rings. crs_ok is
    whether the feature's named CRS is the expected one, which one without a name is.
    """
    schema = f"properties struct<{properties}>, geometry struct<type: string, coordinates: string>, crs struct<properties: struct<name: string>>"
    lines = spark.read.schema(schema).json(path)
    one = F.from_json("geometry.coordinates", _POINTS)
    many = F.flatten(F.from_json("geometry.coordinates", f"array<{_POINTS}>"))
    rings = F.when(F.col("geometry.type") == "Polygon", one).when(F.col("geometry.type") == "MultiPolygon", many)
    whole = F.forall(rings, lambda ring: F.forall(ring, lambda p: F.size(p) >= 2))
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    code = F.regexp_extract("crs.properties.name", "([0-9]+)$", 1)
    return lines.select("properties.*", F.when(whole, points).alias("rings"), F.coalesce(code == crs.split(":")[-1], F.lit(True)).alias("crs_ok"))


def write_chips(chips: DataFrame, path: str) -> None:
    """A chip store, one row a chip."""
    chips.write.parquet(path)


def read_npy_dir(spark: SparkSession, path: str) -> DataFrame:
    """Name, shape and values (in C order) of the .npy files below a folder; error, and no values, for an unreadable one."""
    import numpy as np

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def rows(it):
        for pdf in it:
            out = {"name": [], "shape": [], "values": [], "error": []}
            for name, raw in zip(pdf["path"], pdf["content"]):
                try:
                    a, error = np.load(io.BytesIO(raw), allow_pickle=False), None
                    shape, values = list(a.shape), a.astype("float64").ravel()
                except (ValueError, EOFError, TypeError) as e:
                    shape, values, error = None, None, str(e)
                for k, v in zip(out, (name.rsplit("/", 1)[1].removesuffix(".npy"), shape, values, error)):
                    out[k].append(v)
            yield type(pdf)(out)

    return files.mapInPandas(rows, "name string, shape array<int>, values array<double>, error string")


def write_metadata(table: DataFrame, path: str) -> None:
    """Chip metadata or a channel map as CSV with a header."""
    table.write.option("header", True).csv(path)


def read_metadata(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table again, with its schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_matrix(matrix: DataFrame, path: str, about: dict[str, str]) -> None:
    """A regression matrix with what is told about it (CRS, source, window size) as constant columns."""
    matrix.withColumns({f"meta_{k}": F.lit(v) for k, v in about.items()}).write.parquet(path)


def band_names(px: DataFrame, rasters: DataFrame, key: str, band: str = "band") -> DataFrame:
    """band_name of each row by raster and band number (from 1); NULL where the raster names fewer bands."""
    named = px.join(rasters.select(key, "band_names"), key, "left")
    return named.withColumn("band_name", F.get("band_names", F.col(band).cast("int") - 1)).drop("band_names")
