"""Importance resampling towards a target: hashed n-gram weights, Gumbel noise, and the highest scores drawn.

The two passes over texts fill arrays: one counts features by bucket in each task, the other adds up the gains of
a document's features. The score that cuts the draw off is found without sorting the corpus: a quantile sketch
brackets it, exact counts outside the bracket accept it or widen it, and only the rows within are sorted.

Features: runs of 1 to ``most_words`` consecutive words, each word a run of letters, digits and characters beyond
ASCII after A-Z are lower-cased; a feature's bucket is the crc32 of its UTF-8 bytes modulo ``buckets``. A bucket's
gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), of s among the corpus's S features and t among the
target's T.

Defined results: a null text has no words; a text without words has weight 0 and, as any with under ``least_words``
words, is never drawn; repeated rows are separate rows with equal scores, of which either comes first; a null id is
noised as an empty string and comes after other ids on ties; an empty corpus gives an empty result, an empty target
gives gains by the corpus alone. Columns of the input other than those asked for are left out, so none can clash.
The gains, ``buckets`` integers, are all that goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import numbered_in_order
from .common import WORD_BYTE, byte_texts, materialize, small_batches

BUCKETS = 10_000
MOST_WORDS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words whose buckets a task remembers, at most; beyond it starts anew.
REMEMBERED = 1 << 18

_SPACED = bytes(ord(chr(b).lower()) if b < 128 and WORD_BYTE[b] else b if b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words of a UTF-8 text."""
    return text.translate(_SPACED).split()


class _Buckets(dict):
    """Bucket by feature, worked out when first asked for."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = crc32(feature) % self.buckets
        return found

    def of(self, words: list[bytes], most_words: int) -> np.ndarray:
        """Buckets of all runs of 1 to ``most_words`` words."""
        runs = [words] + [list(map(b" ".join, zip(*(words[i:] for i in range(n))))) for n in range(2, most_words + 1)]
        return np.concatenate([np.fromiter(map(self.__getitem__, x), np.int64, len(x)) for x in runs])


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> np.ndarray:
    """Features of all texts by bucket. Each task sends one row for each bucket that it met."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for x in byte_texts(batch.column(0)):
                total += np.bincount(found.of(words_of(x), most_words), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": met, "n": total[met]})

    sums = texts.select(F.col(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, from the counts of both sides."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scores(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), seed: int = SEED, buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, the columns of ``keep``, n_words, n_features, weight, score and _uid of every document, stored."""
    docs = docs.select(doc_id, text, *[c for c in keep if c not in (doc_id, text)])
    gain = gains(bucket_counts(docs, text, buckets, most_words), bucket_counts(target, text, buckets, most_words))
    kept = [c for c in docs.columns if c != text or text in keep]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(f"_{c}", T.LongType()) for c in ("words", "features", "weight")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Buckets(buckets)
        for batch in batches:
            numbers = []
            for x in byte_texts(batch.column(text)):
                words = words_of(x)
                at = found.of(words, most_words)
                numbers.append((len(words), len(at), int(gain[at].sum())))
            three = np.array(numbers, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(x) for x in three], names=schema.names)

    rows = docs.mapInArrow(score, schema)
    named = [F.col(c) for c in kept if c not in ("n_words", "n_features", "weight", "score", "_uid")]
    rows = rows.select(*named, F.col("_words").alias("n_words"), F.col("_features").alias("n_features"), F.col("_weight").alias("weight"))
    rows = rows.withColumns({"score": F.col("weight") + noise(F.col(doc_id), seed), "_uid": F.monotonically_increasing_id()})
    return materialize(rows, "scores", "zstd")


def cutoff(scored: DataFrame, k: int, n: int, order: list[Column], width: float = 0.002) -> dict:
    """The k-th of the n rows by falling score, as a row; 1 <= k <= n.

    The sketch's quantiles at both sides of k's bracket it. Rows above and below are counted exactly; unless k falls
    between, the bracket gets four times as wide, in the end as wide as all rows. Only its rows are sorted.
    """
    while True:
        low, high = 1 - k / n - width, 1 - k / n + width
        marks = scored.agg(F.percentile_approx("score", F.array(F.lit(max(low, 0.0)), F.lit(min(high, 1.0))), 10_000).alias("m")).first().m
        under = F.col("score") < marks[0] if low > 0 else F.lit(False)
        over = F.col("score") > marks[1] if high < 1 else F.lit(False)
        above, below = scored.agg(F.count_if(over), F.count_if(under)).first()
        if above < k <= n - below:
            break
        width *= 4
    inside = numbered_in_order(scored.where(~over & ~under), order, "_place")
    return inside.where(F.col("_place") == k - above).first().asDict()


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> DataFrame:
    """scores() of every document, and rank: 1, 2, 3... for the drawn ones, by falling score and then id; else null."""
    scored = scores(docs, target, doc_id, text, keep, seed, buckets, most_words)
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    k = percent * n // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long")).drop("_uid")
    order = [F.desc("score"), F.asc_nulls_last(doc_id), F.asc("_uid")]
    last = cutoff(scored.where(able), k, n, order)
    same, least = F.col("score") == last["score"], F.col("_uid") <= last["_uid"]
    if last[doc_id] is None:
        within = F.col(doc_id).isNotNull() | least
    else:
        within = F.coalesce((F.col(doc_id) < last[doc_id]) | ((F.col(doc_id) == last[doc_id]) & least), F.lit(False))
    drawn = able & ((F.col("score") > last["score"]) | (same & within))
    ranked = numbered_in_order(scored.where(drawn), order)
    return ranked.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))).drop("_uid")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, with the benchmark texts as the target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the crc32 of a text's UTF-8 bytes; its query must join the one row of crc, from CRC_SQL."""
    at = f"(instr('0123456789ABCDEF', substr(hex(encode({text})), (2*i+1)::INT, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode({text})), (2*i+2)::INT, 1)) - 1"
    values = f"list_transform(range(octet_length(encode({text}))), lambda i: ({at})::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {values}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


#: The table that crc32_sql() needs: what the checksum does with each byte.
CRC_SQL = """crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
   FROM range(256) r(i))"""
ORACLE = rf"""
WITH {CRC_SQL},
d AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
v AS (SELECT w, {crc32_sql("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM w), crc),
f AS (SELECT side, doc_id, bucket, count(*) AS n FROM w JOIN v USING (w) GROUP BY ALL),
c AS (SELECT i AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
   FROM range(10000) r(i) LEFT JOIN f ON f.bucket = i GROUP BY i),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM c),
p AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
q AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
   CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN p USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM q),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""
