import math

import numpy as np
from gridloom.llm import topk as T
from pyspark.sql import functions as F


def plain(rows, k, query=lambda i: i is not None and i % 20 == 0):
    """Every query against every other row, by Python integers."""
    whole = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in whole:
        if query(i):
            scored = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, p)))), j) for m, j, p in whole if m != n]
            scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return out


def found(spark, rows, k=20, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    return [tuple(x) for x in T.top_k(df, F.col("vec_id") % 20 == 0, k=k, **more).select("query_id", "rank", "vec_id", "score").collect()]


def same(a, b):
    key = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_random_clusters_and_ties(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET", 64)
    monkeypatch.setattr(T, "BLOCK", 32)
    r = np.random.default_rng(3)
    v = r.normal(size=(900, 8)) * r.lognormal(sigma=0.7, size=(900, 1))
    v[300:600] = v[300] * 3 + r.normal(size=(300, 8)) * 0.02  # a third are near copies, long ones
    v[600:640] = v[300]  # and exact copies of one
    v[640:700] = np.round(v[640:700])
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    same(found(spark, rows), plain(rows, 20))
    same(found(spark, rows, k=3), plain(rows, 3))


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, []), (120, [0.0, 0.0]), (-20, [1e10, -1e10]), (140, [3e12, 5.0]), (160, [-3e12, 1.0])]
    rows += [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (0, [1.0, 2.0]), (3, [0.5, 0.5, 0.5]), (5, [-0.001, 0.0])]
    same(found(spark, rows), plain(rows, 20))
    assert found(spark, [(20, None)]) == [] and found(spark, [(1, [1.0])]) == [] and found(spark, [(20, [1.0])]) == []


def test_coordinates_prune(spark):
    """The interval holds every unit vector that reaches the threshold, and pruning by it is used."""
    r = np.random.default_rng(4)
    a, b = r.normal(size=(2, 4000, 6))
    b = a + b * 0.3
    a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    low, high = T.feasible(a, (a * b).sum(1, keepdims=True))
    assert ((low <= b) & (b <= high)).all()
    assert ((high - low)[(a * b).sum(1) > 0.99] < 1).all()


def test_query_equals_plain(spark):
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = [tuple(x) for x in T.op11_top_k(spark, "/root/testdata/sf0.001").select("query_id", "rank", "vec_id", "score").collect()]
    same(got, plain(rows, 20))
