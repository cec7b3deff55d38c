"""Helpers that the training-data operators share.

Shared storage: everything that outlives a job is a table or file below the folder named by
``spark.checkpoint.dir`` (a folder that all executors see); only where a session in one process has none, as in
tests, a temporary folder takes its place.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, without a slash at its end. A cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dir[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of tables made within each open passing(), the innermost last.
_made: list[list[str]] = []


def materialize(df: DataFrame, name: str, codec: str = "snappy", last: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    Within passing(), the table goes when that ends; with ``last`` it is what stays.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    for paths in _made[-1 - last : len(_made) - last]:
        paths.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """Delete the tables that materialize() makes within. What is read afterwards must be made with ``last``, or before."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows and bytes of the session's Arrow batches, so that batches of very long texts fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 24))


def with_row_id(df: DataFrame, name: str = "_uid") -> DataFrame:
    """Number the rows. The numbers repeat from scan to scan as long as ``df`` reads stored data, as it should here.

    doc_id can be null or repeat, so joins within an operator use this number instead.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(df: DataFrame, name: str = "_uid") -> DataFrame:
    """The rows with numbers, stored with them in the shared folder: later reads see the same numbers whatever has become of ``df`` or the executors."""
    return materialize(with_row_id(df, name), "rows", "zstd")


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def by_size(items: list[bytes], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Cut a list into ranges of at most ``most`` bytes (or one item)."""
    start, total = 0, 0
    for i, x in enumerate(items):
        if total and total + len(x) > most:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(items):
        yield start, len(items)


def open_store(path: str):
    """The Arrow file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def put_file(store, path: str, parts) -> None:
    """Write a file under a name of its own, then rename it: a retried task replaces it whole."""
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(attempt) as out:
        for x in parts:
            out.write(x)
    store.move(attempt, path)


def get_bytes(store, path: str) -> np.ndarray:
    """The bytes of a file, memory-mapped where the store is a local or mounted folder."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


# --- polynomial hashes over bytes, arithmetic modulo 2**64 -------------------------------------------------

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_byte_value = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n; the table grows with the longest text seen."""
    table = _powers.get(base)
    if table is None or len(table) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        table = np.full(size, base % 2**64, U)
        table[0] = 1
        _powers[base] = table = np.cumprod(table)
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; ``values`` are bytes or 64-bit hashes."""
    v = _byte_value[values] if values.dtype == np.uint8 else values
    out = np.zeros(len(v) + 1, U)
    np.cumsum(v * powers(BASE, len(v))[: len(v)], out=out[1:])
    return out


_INVERSE = pow(BASE, -1, 2**64)


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal contents wherever they are."""
    return (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]


# --- connected components ------------------------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has the columns a and b of one orderable type. Returns (node, component), component being the
    smallest node that can be reached; nodes without an edge to another are left out. Each round is two
    joins and ends in a table in the shared folder; the number of rounds grows with the logarithm of the
    largest component. Nodes with very many edges are the skewed side of an equi-join, which adaptive
    execution splits.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    stars = materialize(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "cc")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(stars)
    while before[0]:
        both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).union(stars.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(small.union(root.select("u", F.col("m").alias("v"))).distinct(), "cc")
        after = state(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


# --- words and bitmaps ---------------------------------------------------------------------------------------

#: Bytes of words: letters, digits and everything beyond ASCII.
WORD_BYTE = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
_SEPARATE = b"\n"


def lower_bytes(column: pa.Array) -> list[bytes]:
    """The lower-cased texts of an Arrow string column as UTF-8; null becomes empty."""
    import pyarrow.compute as pc

    return byte_texts(pc.utf8_lower(column))


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in a row, and the number of words of each text."""
    buf = np.frombuffer(_SEPARATE + _SEPARATE.join(data) + _SEPARATE, np.uint8)
    flag = WORD_BYTE[buf]
    start, end = np.flatnonzero(~flag[:-1] & flag[1:]) + 1, np.flatnonzero(flag[:-1] & ~flag[1:]) + 1
    hashes = mix(span_hashes(prefix_hashes(buf), start, end))
    edges = np.cumsum([0, *[len(x) + 1 for x in data]])
    return hashes, np.diff(np.searchsorted(start, edges + 1))


#: Bits of a bitmap that goes to executors or to the driver: at least, and at most (16 MB), whatever the number of keys.
BITMAP = 1 << 23
MOST_BITS = 1 << 27


def bitmap(keys: DataFrame, key: str, n: int = 0) -> np.ndarray:
    """A Bloom filter with two bits for each of ``n`` 64-bit keys, as bytes. Of bounded size: with very many keys it lets more pass."""
    size = min(MOST_BITS, max(BITMAP, 1 << (16 * n).bit_length()))
    at = F.explode(F.array(F.col(key).bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(size - 1))))
    bits = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words, found = np.zeros(size >> 6, np.int64), bits.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words[found.column("word").to_numpy()] = found.column("bit").to_numpy()
    return words.view(np.uint8)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit keys may be in the bitmap."""
    out, last = None, U(8 * len(bits) - 1)
    for at in (keys & last, (keys >> U(32)) & last):
        at = at.astype(np.int64)
        hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        out = hit if out is None else out & hit
    return out
