"""Quality rules: rules on each text, then a verdict on each host from its shrunk failure rate.

A host (here a document's source) fails as a whole if the posterior mean of its failure rate, under a beta
prior fitted to all hosts, is over ``max_rate``; its documents are then dropped whatever they look like.

Defined results: a null or empty text has no words, so it fails; a null source is a host of its own;
repeated rows count and come out as often as they come in; an empty table gives an empty result; other
columns are untouched (the operator's own start with ``_q``). Texts are read whole, one at a time.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches

MIN_WORDS = 10
WINDOW = 5
#: Percent of words in repeated windows.
MAX_REPEATED = 20
MAX_HOST_RATE = 0.5
#: Hosts that fail as a whole are broadcast up to this number, else joined by a shuffle.
BROADCAST_HOSTS = 100_000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
METRICS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Number of words in windows of k words that the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(k))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = end = 0
    for i, x in enumerate(windows):
        if counts[x] > 1:
            total += i + k - max(i, end)
            end = i + k
    return total


def measure(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one UTF-8 text."""
    words = data.split()
    chars = len(data) if data.isascii() else len(data.decode())
    blanks = sum(data.count(SPACES[i : i + 1]) for i in range(len(SPACES)))
    symbols = sum(data.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), chars - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the metrics, and _qfailed, to the columns ``keep`` (all by default). No shuffle."""
    small_batches(docs.sparkSession)
    names = docs.columns if keep is None else keep
    docs = docs.select(*names, F.col(text).cast("binary").alias("_qtext"))
    schema = docs.drop("_qtext").withColumns({k: F.lit(None).cast(v) for k, v in METRICS.items()}).schema

    def batches(it):
        for batch in it:
            found = [measure(x or b"") for x in batch.column("_qtext").to_pylist()]
            out = {n: batch.column(n) for n in batch.schema.names if n != "_qtext"}
            for j, n in enumerate(METRICS):
                out[n] = pa.array([x[j] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([out[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    return docs.mapInArrow(batches, schema).withColumn("base_failed", failed())


def failed():
    """The rules on a text: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def host_verdicts(rows: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(_qhost, _qn, _qfails, _qrate, _qbad) for each host: failure rates shrunk by an empirical beta prior.

    The prior has the hosts' mean rate and, by the method of moments, their variance beyond what binomial
    noise explains; where there is none left, the rates shrink to the mean.
    """
    by = rows.groupBy(F.col(host).alias("_qhost")).agg(F.count("*").alias("_qn"), F.sum(F.col("base_failed").cast("long")).alias("_qfails"))
    by = materialize(by, "hosts")
    rate = F.col("_qfails") / F.col("_qn")
    s = by.agg(F.sum("_qfails"), F.sum("_qn"), F.var_pop(rate), F.avg(1 / F.col("_qn"))).first()
    mean = float(s[0] or 0) / max(1, s[1] or 0)
    noise = mean * (1 - mean) * float(s[3] or 0)
    extra = float(s[2] or 0) - noise
    strength = min(1e6, max(1.0, mean * (1 - mean) / extra - 1)) if extra > 0 else 1e6
    shrunk = (F.col("_qfails") + mean * strength) / (F.col("_qn") + strength)
    return by.withColumn("_qrate", shrunk).withColumn("_qbad", shrunk > max_rate)


def bad_hosts(verdicts: DataFrame) -> DataFrame:
    """Hosts to drop, hinted as a broadcast only where a count has shown that they are few."""
    bad = verdicts.where("_qbad").select("_qhost")
    return F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad


def judge(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The columns but the text, the metrics, base_failed, host_rate (shrunk), host_failed and kept, one row for each of ``docs``.

    Texts are read once; only the counts are stored and joined.
    """
    keep = [c for c in docs.columns if c != text and c not in METRICS and c not in ("base_failed", "host_rate", "host_failed", "kept")]
    rows = materialize(measured(docs, text, keep), "quality")
    hosts = host_verdicts(rows, host)
    hosts = hosts.select("_qhost", F.round("_qrate", 9).alias("host_rate"), F.col("_qbad").alias("host_failed"))
    rows = rows.join(F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts, rows[host].eqNullSafe(hosts["_qhost"]), "left")
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("_qhost")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that judge() keeps, in their own columns.

    The first pass over the texts leaves counts by host, the second filters; texts are never shuffled.
    """
    verdicts = host_verdicts(measured(docs.select(text, host), text, [host]), host)
    bad = bad_hosts(verdicts)
    safe = docs.select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"_q{i}" for i, c in enumerate(docs.columns)}
    rows = measured(safe, at[text]).where("not base_failed")
    rows = rows.join(bad, rows[at[host]].eqNullSafe(bad["_qhost"]), "left_anti")
    return rows.select(*[F.col(at[c]).alias(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base_failed, the host's shrunk rate and verdict, and kept of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", *METRICS, "base_failed", "host_rate", "host_failed", "kept")


ORACLE = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS gram FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k.j) AS n_repeat_words FROM r, range(5) AS k(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM f GROUP BY source),
s AS (SELECT sum(k) / sum(n) AS mean, var_pop(k / n) - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * avg(1 / n) AS extra FROM h),
p AS (SELECT mean, CASE WHEN extra > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / extra - 1)) ELSE 1e6 END AS strength FROM s),
v AS (SELECT source, (k + mean * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 9) AS host_rate, rate > 0.5 AS host_failed, NOT base_failed AND NOT rate > 0.5 AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
