import math
import re
import zlib
from collections import Counter
from hashlib import sha256

from gridloom.llm import resample as R
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, least=20, percent=10, n=1, buckets=10000, seed=2024):
    def features(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in docs:
        words, found = features(text)
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return Counter(tuple(x[:5]) for x in out)


def rows_of(df):
    return Counter((x.doc_id, x.n_features, x.weight, x.score, x.rank) for x in df.collect())


def test_odd_documents(spark, odd_docs):
    docs = [(x.doc_id, x.text) for x in odd_docs.collect()]
    target = spark.createDataFrame([("a B c text",), (None,), ("Ünï 1",)], "text string")
    words = [x.text for x in target.collect()]
    for percent, least, n in ((10, 20, 1), (50, 1, 2), (100, 0, 3), (0, 0, 1)):
        got = R.resample(odd_docs.withColumn("weight", F.lit("clash")), target, keep=("weight", "source"), percent=percent, least_words=least, most_words=n)
        assert rows_of(got) == plain(docs, words, least, percent, n)
        assert "source" in got.columns
    assert R.resample(odd_docs.limit(0), target).count() == 0
    assert rows_of(R.resample(odd_docs, target.limit(0), percent=50, least_words=1)) == plain(docs, [], 1, 50)


def test_bracket_widens(spark):
    """Scores on which a quantile sketch is far off: many ties, and a bracket that starts too narrow."""
    scored = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").alias("_uid"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("long").alias("score"))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("_uid")]
    ranked = sorted(((-x.score, x.doc_id) for x in scored.collect()))
    for k in (1, 2, 700, 2500, 3500, 4999, 5000):
        x = R.cutoff(scored, k, 5000, order, 1e-7)
        assert (-x["score"], x["doc_id"]) == ranked[k - 1]


def test_query_equals_plain(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect()
    want = plain([(x.doc_id, x.text) for x in read("documents")], [x.text for x in read("benchmark")])
    assert rows_of(R.op12_importance_resampling(spark, "/root/testdata/sf0.001")) == want
