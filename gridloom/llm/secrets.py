"""Secret scan over content-addressed texts, with a ledger of what each rule version has seen.

Every text is a blob named by its SHA-256. A run scans only pairs of blob and rule version that the ledger
lacks, and one copy of each blob; the findings are then joined to every row (path) that holds the blob.
Built-in expressions only.

The ledger is a folder of Parquet runs by the first byte of the blob, _spart: (_sblob, _srule, _sm), _sm holding,
for each match in order, the code points since the match before, its length and whether it passes the rule's length
test. Positions are running sums over those, so a text with very many matches needs no quadratic work. A run reads
the parts that its own blobs fall in, and of these only its own blobs' matches, however much history the ledger has.

Defined results: a null text is the empty blob, without findings; repeated rows each get their blob's
findings; an empty table gives an empty result; helper columns start with ``_s`` and other columns are
passed on. A blob in very many rows is the skewed left side of the last join, which adaptive execution splits.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, materialize, numbered


class Rule(NamedTuple):
    """A match counts if its group ``group`` has ``least`` code points or more. A new version is scanned anew."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The contract's three kinds, then those that this scan adds.
BASE_RULES = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
RULES = BASE_RULES + ADDED_RULES
#: Cheap tests for texts that can have a match which counts; they must hold for every such text.
_HINT = {"hex": r"[0-9a-f]{32}", "access": r"AKIA[A-Z0-9]{12}"}


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap,len,ok>>: the leftmost non-overlapping matches of a rule."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    size = whole if not rule.group else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    found = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("len"), size.alias("size")), lambda x: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), (x["size"] >= rule.least).alias("ok")))
    none = F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(_HINT.get(rule.kind, rule.pattern)), found).otherwise(none)


def _part(blob: Column) -> Column:
    """The blob's first byte, as a number."""
    return F.conv(F.hex(F.substring(blob, 1, 1)), 16, 10).cast("int")


def scan(docs: DataFrame, ledger: str, text: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what ``ledger`` lacks and add a run to it; ``docs`` with _sblob instead of the text, and (_sblob, _spart) of its blobs."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blob = F.unhex(F.sha2(body, 256))
    rows = numbered(docs, "_suid")
    blobs = rows.select(blob.alias("_sblob"), "_suid").groupBy("_sblob").agg(F.min("_suid").alias("_suid"))
    blobs = materialize(blobs.withColumn("_spart", _part(F.col("_sblob"))), "secret-blobs")
    pairs = blobs.withColumn("_srule", F.explode(F.lit([r.key for r in rules])))
    seen = read_ledger(spark, ledger, blobs)
    if seen is not None:
        pairs = pairs.join(seen.select("_sblob", "_srule").distinct(), ["_sblob", "_srule"], "left_anti")
    todo = pairs.groupBy("_suid").agg(F.first("_sblob").alias("_sblob"), F.first("_spart").alias("_spart"), F.collect_set("_srule").alias("_srules"))
    found = rows.select("_suid", body.alias("_stext")).join(todo, "_suid")
    each = [F.when(F.array_contains("_srules", r.key), F.struct(F.lit(r.key).alias("_srule"), matches(F.col("_stext"), r).alias("_sm"))) for r in rules]
    runs = found.select("_sblob", "_spart", F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))
    runs.repartition("_spart").sortWithinPartitions("_spart", "_sblob").write.mode("append").partitionBy("_spart").parquet(ledger)
    return rows.select(*[c for c in docs.columns if c != text], blob.alias("_sblob")), blobs.select("_sblob", "_spart")


def read_ledger(spark: SparkSession, ledger: str, blobs: DataFrame | None = None) -> DataFrame | None:
    """The ledger's runs, of some blobs (_sblob, _spart) only where these are given; None before the first run."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    runs = spark.read.schema("_sblob binary, _srule string, _sm array<struct<gap:int,len:int,ok:boolean>>, _spart int").parquet(ledger)
    if blobs is None:
        return runs
    parts = [r["_spart"] for r in blobs.select("_spart").distinct().collect()]  # 256 at most
    return runs.where(F.col("_spart").isin(parts)).join(blobs.select("_sblob"), "_sblob", "left_semi")


def findings(spark: SparkSession, ledger: str, rules=RULES, blobs: DataFrame | None = None) -> DataFrame:
    """(_sblob, kind, start, end) for every match of the current rules that counts, of some blobs or all; ``end`` is exclusive."""
    rows = read_ledger(spark, ledger, blobs).where(F.col("_srule").isin([r.key for r in rules])).where(F.exists("_sm", lambda x: x["ok"]))
    rows = rows.dropDuplicates(["_sblob", "_srule"]).select("_sblob", "_srule", F.posexplode("_sm").alias("_si", "_sx"))
    upto = Window.partitionBy("_sblob", "_srule").orderBy("_si").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("_sx.gap").cast("long") + F.col("_sx.len")).over(upto)
    rows = rows.withColumn("end", end).where("_sx.ok")
    return rows.select("_sblob", F.substring_index("_srule", "@", 1).alias("kind"), (F.col("end") - F.col("_sx.len")).alias("start"), "end")


def report(docs: DataFrame, ledger: str, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` without the text and with n_assign, n_access, n_hex, base_sha256 and spans."""
    paths, blobs = scan(docs, ledger, text, rules)
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    rows = findings(docs.sparkSession, ledger, rules, blobs).select("_sblob", F.struct("start", order[F.col("kind")].alias("rank"), "kind", "end").alias("_sx"))
    by = rows.groupBy("_sblob").agg(F.sort_array(F.collect_list("_sx")).alias("_sx"))
    by = by.withColumn("_sbase", F.filter("_sx", lambda x: x["rank"] < len(BASE_RULES)))
    names = lambda column: F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("_sbase", lambda x: x["kind"] == kind)).cast("long")
    by = by.select("_sblob", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(names("_sbase"), 256).alias("base_sha256"), names("_sx").alias("spans"))
    new = [c for c in by.columns if c != "_sblob"]
    joined = paths.drop(*new).join(by, "_sblob", "left")
    nothing = {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    return joined.select(*[c for c in paths.columns if c not in new and c != "_sblob"], *[F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in new])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every document, with a new ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return report(docs, fresh_path(spark, "secret-ledger")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
