"""URL filter: host and path rules, then a blocked Bloom filter of listed URLs before an exact hash join.

Built-in expressions only. The filter is a table of 64-bit words, one a block, a block for each four listed URLs. It is
broadcast up to ``MAX_BLOCKS`` rows, and joined by block beyond, so it refuses as much with a list of any length.
Rows that it refuses, or that a rule decides, are in no join after it. Defined results: a null URL, or one without ``://``, has an empty host and path, no rule
and no listing, so it is allowed; repeated rows are judged alike; an empty table gives an empty result;
columns of the input other than the URL are passed on, and helper columns start with ``_u``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's rules (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: First labels of hosts whose pages make up the default list.
LISTED_LABELS = ("adult-x", "spam-farm", "cheap-pills", "ads-track", "casino-win", "free-bets")
#: Rows of a filter that is broadcast, at most: 16 bytes each.
MAX_BLOCKS = 1 << 20
BITS = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL by the contract's definition; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., m. or blog., and path without .html and a slash at the end."""
    return F.concat(F.regexp_replace(host, r"^(www|m|blog)\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> Column:
    """A 64-bit word with BITS bits set by a second hash of the key."""
    h = F.xxhash64(key, F.lit(7))
    word = F.lit(0).cast("long")
    for i in range(BITS):
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return word


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter of the column ``_ukey``: (_ublock, _uword), at most ``blocks`` rows."""
    block = F.pmod(F.xxhash64("_ukey"), F.lit(blocks))
    return listed.select(block.alias("_ublock"), _bits(F.col("_ukey")).alias("_uword")).groupBy("_ublock").agg(F.bit_or("_uword").alias("_uword"))


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``; ``listed`` has canonical URLs in ``key``.

    Only URLs that no rule fits and that the filter passes are looked up in the list; the lookup is a
    distinct-keyed equi-join, so no page is doubled. The pages are read once for rows that pass and once for the
    others, instead of being shuffled. Possible hits with one key in very many rows are the
    skewed left side of that join, which adaptive execution splits.
    """
    h, p = host_and_path(F.col(url))
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": h, "path": p})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_usays": says})
    rows = rows.withColumn("_ukey", F.when(F.col("_usays").isNull() & (F.col("host") != ""), canonical(F.col("host"), F.col("path"))))
    exact = listed.where("key is not null").select(F.col("key").alias("_ukey")).distinct()
    blocks = max(64, 1 << max(0, exact.count() // 4).bit_length())
    words = bloom(exact, blocks)
    rows = rows.withColumn("_ublock", F.pmod(F.xxhash64("_ukey"), F.lit(blocks)))
    rows = rows.join(F.broadcast(words) if blocks <= MAX_BLOCKS else words, "_ublock", "left")
    passed = F.coalesce(F.col("_uword").bitwiseAND(_bits(F.col("_ukey"))) == _bits(F.col("_ukey")), F.lit(False))
    hits = rows.where(passed).join(exact.withColumn("_uhit", F.lit(True)), "_ukey", "left")
    both = hits.unionByName(rows.where(~passed), allowMissingColumns=True)
    verdict = F.coalesce("_usays", F.when(F.col("_uhit"), "block").otherwise("allow"))
    return both.withColumn("verdict", verdict).drop("_usays", "_ukey", "_ublock", "_uword", "_uhit")


def listed_urls(pages: DataFrame, url: str = "url", labels=LISTED_LABELS) -> DataFrame:
    """The default list: canonical URLs of pages whose host has one of the listed labels."""
    h, p = host_and_path(F.col(url))
    pages = pages.select(h.alias("h"), p.alias("p"))
    return pages.where(F.arrays_overlap(F.split("h", r"\."), F.lit(list(labels)))).select(canonical(F.col("h"), F.col("p")).alias("key")).distinct()


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


_LABELS = ", ".join(f"'{x}'" for x in LISTED_LABELS)
ORACLE = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, rest FROM a),
c AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(raw_host) + 1), '^([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, CASE
   WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
   WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
   WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
   WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
   regexp_replace(host, '^(www|m|blog)\\.', '') || regexp_replace(path, '(\\.html)?/*$', '') AS k FROM c),
l AS (SELECT DISTINCT k FROM d WHERE list_has_any(string_split(host, '.'), [{_LABELS}]))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
   WHEN host <> '' AND k IN (SELECT k FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM d
"""
