"""Exact top-k search by inner product over vectors bucketed by length.

Vectors are numbered by falling length and cut into buckets. Rounds go through the buckets from the longest on,
each round four times as many vectors as all before it, so that what a query has found bounds what the next round
sends. A round joins blocks of queries with its buckets; a task takes one block and one bucket at a time. From the
query's threshold (its k-th score so far) and the bucket's greatest length follows a local cosine threshold: over
1, the bucket is skipped; else the bucket is pruned by length (its vectors are sorted by it) or, where the local
threshold leaves few vectors in the feasible interval of the query's largest coordinates, by those coordinates.
What is left is multiplied out, in whole numbers.

Every component x becomes floor(``scale`` x). Defined results: a vector that is null or holds a null or non-finite
component takes no part; a vector of fewer components than another counts as padded with zeros, an empty one has
score 0 with all; rows with a repeated id are vectors of their own, and a query meets all rows but its own; a null
id is no query and comes last among ties, repeated ids come in the stored order; a score beyond 64 bits is given
as the nearest 64-bit value; an empty table gives an empty result; other columns are left out, so none can clash.
Memory: one block and one bucket a task, both of bounded size, however many vectors are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import numbered_in_order
from .common import materialize, small_batches

SCALE = 64.0
K = 20
EVERY = 20
#: Rows of a bucket and of a block of queries, at most; fewer where vectors are long.
BUCKET, BLOCK = 1024, 2048
#: How many times the vectors of all rounds before it a round ends with.
GROWTH = 4
#: Coordinates looked at, and how few vectors they must leave, as a share of those that length leaves.
FOCUS, FEW = 3, 1 / 8
_LAST = np.iinfo(np.int64).max
_EXACT = 2.0**53


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, length, dim, vec) of the rows that take part; vec has the scaled components as 64-bit floats."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten()
            bad = values.is_null().to_numpy(zero_copy_only=False)
            x = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                x, bad = np.floor(x * scale), bad | ~np.isfinite(x)
            sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            faults = np.concatenate([[0], np.cumsum(bad)])
            good = np.flatnonzero((faults[ends[1:]] == faults[ends[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False))
            parts = [x[ends[i] : ends[i + 1]] for i in good]
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(pa.array(good)),
                    "length": pa.array([float(np.sqrt(v @ v)) for v in parts], pa.float64()),
                    "dim": pa.array(sizes[good]),
                    "vec": pa.array([v.tobytes() for v in parts], pa.binary()),
                }
            )

    picked = rows.select(F.col(vec_id).cast("long"), F.col(vector).cast("array<double>"))
    return picked.mapInArrow(convert, "vec_id long, length double, dim long, vec binary")


class _Rows:
    """Vectors of a bucket or block, by their numbers: by falling length."""

    def __init__(self, cell: pa.StructScalar | pa.ListScalar):
        at = cell.values
        order = np.argsort(at.field("number").to_numpy())
        column = lambda name, null=0: at.field(name).fill_null(null).to_numpy(zero_copy_only=False)[order]
        self.number, self.id = column("number"), column("vec_id", _LAST)
        self.null = at.field("vec_id").is_null().to_numpy(zero_copy_only=False)[order]
        self.length = column("length")
        raw = at.field("vec").to_pylist()
        self.raw = [raw[i] for i in order]
        self.floor = None
        if "least" in [f.name for f in at.type]:
            self.known = at.field("least").is_valid().to_numpy(zero_copy_only=False)[order]
            self.floor, self.floor_id, self.floor_number = column("least"), column("least_id", _LAST), column("least_number")

    def matrix(self, dim: int) -> np.ndarray:
        """One vector a row, padded to ``dim`` components."""
        if all(len(x) == 8 * dim for x in self.raw):
            return np.frombuffer(b"".join(self.raw), np.float64).reshape(-1, dim)
        return np.frombuffer(b"".join(x.ljust(8 * dim, b"\0") for x in self.raw), np.float64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of all rows of a with all rows of b; ``most`` bounds them. Exact, then clipped to 64 bits."""
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -_LAST - 1, _LAST).astype(np.int64)


def feasible(query: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval that a unit vector's coordinate must lie in to reach ``cosine`` with a unit vector that has ``query`` there."""
    spread = np.sqrt(np.clip(1 - cosine**2, 0, None) * np.clip(1 - query**2, 0, None)) + 1e-9
    return np.where(query <= -cosine, -1.0, query * cosine - spread), np.where(query >= cosine, 1.0, query * cosine + spread)


def search(block: _Rows, bucket: _Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the block, places in the bucket and scores of each query's k best of the bucket that beat its threshold."""
    dim = max(max(map(len, block.raw)), max(map(len, bucket.raw))) // 8
    q, p = block.matrix(dim), bucket.matrix(dim)
    longest, reach = bucket.length[0], block.length[0]
    # a score beyond 64 bits has been clipped, and so may be a threshold: it still bounds from below
    floor = np.where(block.known, block.floor.astype(np.float64) * (1 - 1e-9 * np.sign(block.floor)), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(block.length > 0, floor / (block.length * longest), np.where(floor > 0, np.inf, -1.0))
        needed = np.where(block.length > 0, floor / block.length, np.where(floor > 0, np.inf, -np.inf))
    left = np.searchsorted(-bucket.length, -needed, side="right")
    left[local > 1 + 1e-9] = 0
    by_coordinates = np.zeros(len(q), bool)
    near = np.flatnonzero((left > 0) & (local > 0.5))
    if len(near) and dim >= FOCUS:
        unit = np.divide(p, bucket.length[:, None], out=np.zeros_like(p), where=bucket.length[:, None] > 0)
        order = np.argsort(unit, axis=0, kind="stable")
        columns = np.take_along_axis(unit, order, axis=0)
        mine = q[near] / block.length[near, None]
        focus = np.argpartition(-np.abs(mine), FOCUS - 1, axis=1)[:, :FOCUS]
        low, high = feasible(np.take_along_axis(mine, focus, axis=1), np.minimum(local[near], 1.0)[:, None])
        first, last = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for c in np.unique(focus):
            at = focus == c
            first[at], last[at] = np.searchsorted(columns[:, c], low[at], "left"), np.searchsorted(columns[:, c], high[at], "right")
        narrow = np.argmin(last - first, axis=1)
        rows = np.arange(len(near))
        few = (last - first)[rows, narrow] < FEW * left[near]
        by_coordinates[near[few]] = True
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if by_coordinates.any():
        for i in np.flatnonzero(few):
            c = narrow[i]
            these = order[first[i, c] : last[i, c], focus[i, c]]
            for j in range(FOCUS):
                if j != c:
                    these = these[(unit[these, focus[i, j]] >= low[i, j]) & (unit[these, focus[i, j]] <= high[i, j])]
            if len(these):
                score = products(q[near[i : i + 1]], p[these], reach * longest)[0]
                found.append((np.full(len(these), near[i]), these, score))
    rest = np.flatnonzero((left > 0) & ~by_coordinates)
    for start in range(0, len(rest), 256):
        some = rest[start : start + 256]
        most = left[some].max()
        score = products(q[some], p[:most], reach * longest)
        least = np.where(block.known[some], block.floor[some], -_LAST - 1)
        if most > k and not block.known[some].all():
            least = np.maximum(least, np.partition(score, most - k - 1, axis=1)[:, most - k - 1])  # one more than k: the query itself may be among them
        a, b = np.nonzero(score >= least[:, None])
        found.append((some[a], b, score[a, b]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, b, score = (np.concatenate(x) for x in zip(*found))
    beats = (score > block.floor[a]) | (score == block.floor[a]) & ((bucket.id[b] < block.floor_id[a]) | (bucket.id[b] == block.floor_id[a]) & (bucket.number[b] < block.floor_number[a]))
    ok = (block.number[a] != bucket.number[b]) & (beats | ~block.known[a])
    a, b, score = a[ok], b[ok], score[ok]
    order = np.lexsort((bucket.number[b], bucket.id[b], ~score, a))  # ~ turns the order about without overflow
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k], score[place < k]


_FOUND = "query long, query_id long, score long, vec_id long, number long"


def top_k(rows: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner products for each row that ``is_query`` (an expression on vec_id)."""
    spark = rows.sparkSession
    small_batches(spark)
    ordered = numbered_in_order(whole_vectors(rows, vec_id, vector, scale).withColumn("_uid", F.monotonically_increasing_id()), [F.desc("length"), F.asc_nulls_last("vec_id"), F.asc("_uid")], "number", 0)
    n, dim = ordered.agg(F.count("*"), F.max("dim")).first()
    size, block_size = (max(32, min(most, (most << 10) // max(dim or 1, 1))) for most in (BUCKET, BLOCK))
    packed = lambda df, key, *more: df.groupBy(key).agg(F.collect_list(F.struct("number", "vec_id", "length", "vec", *more)).alias("rows"))
    buckets = materialize(packed(ordered.withColumn("bucket", F.expr(f"number DIV {size}")), "bucket"), "buckets", "zstd")
    queries = numbered_in_order(ordered.where(is_query), [F.asc("number")], "_place", 0).withColumn("block", F.expr(f"_place DIV {block_size}"))
    blocks = -(-queries.count() // block_size)
    best = spark.createDataFrame([], _FOUND)
    if not blocks:
        return best.selectExpr("query_id", "1 AS rank", "vec_id", "score")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, other in zip(batch.column(0), batch.column(1)):
                block, bucket = _Rows(cell), _Rows(other)
                a, b, score = search(block, bucket, k)
                ids = lambda rows, at: pa.array(rows.id[at], mask=rows.null[at])
                yield pa.RecordBatch.from_pydict({"query": block.number[a], "query_id": ids(block, a), "score": score, "vec_id": ids(bucket, b), "number": bucket.number[b]})

    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "number")
    total, start = -(-n // size), 0
    while start < total:
        end = min(total, start * GROWTH or 1)
        least = best.where(F.col("rank") == k) if start else best
        least = least.select(F.col("query").alias("number"), F.col("score").alias("least"), F.col("vec_id").alias("least_id"), F.col("number").alias("least_number"))
        asked = packed(queries.join(least, "number", "left"), "block", "least", "least_id", "least_number")
        slots = min(end - start, -(-2 * spark.sparkContext.defaultParallelism // blocks))
        asked = asked.select("block", F.col("rows").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        given = buckets.where(F.col("bucket").between(start, end - 1)).select("rows", (F.col("bucket") % slots).cast("int").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"))
        new = asked.join(given, ["block", "slot"]).select("asked", "rows").mapInArrow(find, _FOUND)
        both = new.unionByName(best.drop("rank")) if start else new
        best = materialize(both.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "best", "zstd")
        start = end
    return best.select("query_id", "rank", "vec_id", "score")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector with all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
