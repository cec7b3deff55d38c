"""SimHash near-duplicates: fingerprints of word shingles, linked where few bits differ.

Equal texts share a fingerprint, so all work on pairs is on distinct fingerprints. Two fingerprints that
differ in at most 2 bits agree on 2 of 4 blocks, so rows of one pair of blocks and their 32 bits meet. There
the pivot distance table decides: each fingerprint carries its Hamming distances to ``PIVOTS`` reference
fingerprints; by the triangle inequality, a pair is within reach only if no coordinate differs by more than
the radius, and only survivors are verified bit by bit. Coordinates alone can't serve as join keys (each
takes few values, and a tolerance of 2 covers about a third of them), which is why blocks bring rows together.

Blocks that more than ``MOST`` fingerprints share aren't paired. Their members are linked through midpoints:
two fingerprints within 2 bits have one in common that is at most 1 bit from either, so a group on
each member's 65 such neighbours, tied to the group's least, has the same components. Work is thus
in proportion to the number of fingerprints however dense they lie.

``keep_one`` takes the same fingerprints, of longer shingles, and links the pairs that they bring together if the Jaccard
similarity of the shingles is 0.8 or more. Fingerprints of such texts may differ in more bits than blocks and pivots can
find (about ten at 0.8), so an exact join on shingles then compares texts that the fingerprints left in different groups.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any
other; a null doc_id takes part and never names a component unless it has no other; repeated rows come out
as often as they come in; an empty table gives an empty result; helper columns start with ``_h``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, connected_components, materialize, numbered, passes, passing, small_batches

SHINGLE = 3
RADIUS = 2
BLOCKS = 4
PIVOTS = 16
MOST = 64
#: One row in so many is read for the shingles that come last in their order.
SAMPLE = 8
#: Shingles held as bits at once; texts may be of any length.
_CHUNK = 1 << 15


def references(n: int = PIVOTS) -> list[int]:
    """The reference fingerprints, as signed 64-bit integers: random, drawn once with a fixed seed."""
    return [int(x) for x in np.random.default_rng(64).integers(-(2**63), 2**63, n, dtype=np.int64)]


def shingle_hashes(data: bytes, k: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of a text's k-word shingles, repeats included; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if len(words) <= k:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-k]]]
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(data: bytes, k: int = SHINGLE, seed: int = 42) -> int:
    """Signed 64-bit SimHash of one UTF-8 text: majority bits of the XXH64 of its k-word shingles."""
    return majority(shingle_hashes(data, k, seed))


def with_fingerprints(docs: DataFrame, text: str = "text", k: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text by default) and _hfp, the fingerprint as a long. No shuffle."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != text] if keep is None else keep
    docs = docs.select(*names, F.col(text).cast("binary").alias("_htext"))
    schema = docs.drop("_htext").withColumn("_hfp", F.lit(0).cast("long")).schema

    def batches(it):
        for batch in it:
            prints = pa.array([fingerprint(x or b"", k) for x in batch.column("_htext").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), prints], names=[*names, "_hfp"])

    return docs.mapInArrow(batches, schema)


def block_keys(fp: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """An array of keys, one for each choice of blocks - radius blocks: the choice's number and the chosen bits."""
    width = 64 // blocks
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        parts = [F.shiftrightunsigned(fp, width * b).bitwiseAND(F.lit((1 << width) - 1)) for b in chosen]
        key = F.lit(i).cast("long")
        for p in parts:
            key = F.call_function("shiftleft", key, F.lit(width)).bitwiseOR(p)
        keys.append(key)
    return F.array(*keys)


def links(prints: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of the distinct longs in ``fp`` within ``radius`` bits."""
    if radius != 2:
        raise ValueError("midpoints are written for radius 2")
    rows = materialize(prints.select("fp", F.explode(block_keys(F.col("fp"))).alias("key")), "simhash-blocks")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(rows.join(sizes, "key"), "simhash-shared")
    pivots = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in references()])
    few = shared.where(F.col("n") <= most).select("key", "fp", pivots.alias("at"))
    a, b = few.select("key", F.col("fp").alias("a"), F.col("at").alias("p")), few.select("key", F.col("fp").alias("b"), F.col("at").alias("q"))
    near = F.forall(F.arrays_zip("p", "q"), lambda x: F.abs(x["p"] - x["q"]) <= radius)
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")))
    pairs = pairs.where(near).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    dense = shared.where(F.col("n") > most).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    mids = dense.select("fp", F.explode(flips).alias("mid"))
    least = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    stars = mids.join(least, "mid").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def components(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(_hfp, component_id) for the distinct fingerprints of rows of (doc_id, _hfp)."""
    least = materialize(prints.groupBy("_hfp").agg(F.min(doc_id).alias("_hmin")), "simhash-distinct")
    linked = connected_components(links(least.select(F.col("_hfp").alias("fp"))))
    linked = linked.select(F.col("node").alias("_hfp"), F.col("component").alias("_hgroup"))
    labels = least.join(linked, "_hfp", "left").withColumn("_hgroup", F.coalesce("_hgroup", "_hfp"))
    smallest = labels.groupBy("_hgroup").agg(F.min("_hmin").alias("component_id"))
    return labels.join(smallest, "_hgroup").select("_hfp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    A fingerprint in very many rows is the skewed left side of the last join, which adaptive execution splits.
    """
    prints = materialize(with_fingerprints(docs.select(doc_id, text), text, k, [doc_id]), "simhash")
    groups = components(prints, doc_id)
    return prints.join(groups, "_hfp").select(doc_id, F.lower(F.lpad(F.hex("_hfp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(data: bytes, k: int) -> np.ndarray:
    """The distinct hashes of a text's k-word shingles, in order."""
    return np.unique(shingle_hashes(data, k))


def jaccard_least(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of 0.8 or more."""
    if min(len(a), len(b)) * 5 < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _common(rows: DataFrame, k: int) -> np.ndarray:
    """A bitmap of shingles that many rows of a sample hold. It only orders shingles: any set gives the same pairs."""

    def batches(it):
        for batch in it:
            for x in batch.column("_ht").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x or b"", k).view(np.int64))], names=["h"])

    part = rows.where(F.pmod(F.xxhash64("_huid"), F.lit(SAMPLE)) == 0).select("_ht").mapInArrow(batches, "h long")
    common = materialize(part.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > MOST // SAMPLE).select("h"), "shingle-common")
    return bitmap(common, "h", common.count())


def _prefixes(rows: DataFrame, k: int) -> DataFrame:
    """_hid, _huid, _hset (a hash of the set of shingles), _hn (its size), _hkeys, the set's prefix, _hbits, its parity, and _hfp, the text's fingerprint.

    In one order of all shingles (common ones last, then by hash), sets with a Jaccard similarity of 0.8 or more share
    one of their first n - ceil(0.8 n) + 1 shingles.
    """
    from xxhash import xxh64_intdigest

    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, k).tobytes())

    def batches(it):
        table = np.frombuffer(shared.value, np.uint8)
        for batch in it:
            name, n, keys, bits, prints = [], [], [], [], []
            for x in batch.column("_ht").to_pylist():
                every = shingle_hashes(x or b"", k)
                prints.append(majority(every))
                s = np.unique(every)
                late = passes(table, s)
                name.append(int(np.uint64(xxh64_intdigest(s.tobytes(), 1)).astype(np.int64)))
                n.append(len(s))
                bits.append(parity(s))
                keys.append(np.r_[s[~late], s[late]][: len(s) - -(-4 * len(s) // 5) + 1].view(np.int64))
            out = [batch.column("_hid"), batch.column("_huid"), pa.array(name, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["_hid", "_huid", "_hset", "_hn", "_hkeys", "_hbits", "_hfp"])

    return rows.mapInArrow(batches, rows.select("_hid", "_huid").withColumns({"_hset": F.lit(0).cast("long"), "_hn": F.lit(0).cast("long"), "_hkeys": F.array().cast("array<long>"), "_hbits": F.lit(b""), "_hfp": F.lit(0).cast("long")}).schema)


def parity(hashes: np.ndarray) -> bytes:
    """Bits that tell whether an odd number of the hashes fall on them: two sets differ in as many hashes as bits, or more.

    At least 1024, and at least two for each hash: of two sets that share little, most bits where either has a hash differ.
    """
    size = max(1024, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 1024
    bits = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ; the longer one is folded to the other's length, which keeps parities."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(u) != len(v):
        u, v = (v, u) if len(u) < len(v) else (u, v)
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return int(np.bitwise_count(u ^ v).sum(dtype=np.int64))


def _possible(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and parities leave a Jaccard similarity of 0.8 possible: differing hashes up to a ninth of both sizes."""

    def batches(it):
        for batch in it:
            total = batch.column("p").to_numpy() + batch.column("q").to_numpy()
            bits = np.array([differing(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(9 * bits <= total, pa.bool_()))

    side = lambda name, n, bits: entries.select(F.col("_hset").alias(name), F.col("_hn").alias(n), F.col("_hbits").alias(bits))
    sized = 5 * F.least("p", "q") >= 4 * F.greatest("p", "q")
    few = pairs.join(side("a", "p", "x").drop("x"), "a").join(side("b", "q", "y").drop("y"), "b").where(sized).select("a", "b")
    both = few.join(side("a", "p", "x"), "a").join(side("b", "q", "y"), "b")
    return both.select("a", "b", "p", "q", "x", "y").mapInArrow(batches, "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more. Sets are made for rows in a bitmap only."""
    pairs = materialize(_possible(pairs, entries), "shingle-possible")
    where = entries.join(pairs.select(F.col("a").alias("_hset")).union(pairs.select("b")).distinct(), "_hset", "left_semi").select("_hset", "_huid")
    where = materialize(where.withColumn("_hmark", F.xxhash64("_huid")), "shingle-wanted")
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(where, "_hmark", where.count()).tobytes())

    def bodies(it):
        table = np.frombuffer(shared.value, np.uint8)
        for batch in it:
            batch = batch.filter(pa.array(passes(table, batch.column("_hmark").to_numpy().view(np.uint64)), pa.bool_()))
            sets = [shingles(x or b"", k).tobytes() for x in batch.column("_ht").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_huid"), pa.array(sets, pa.binary())], names=["_huid", "body"])

    marked = rows.select("_huid", "_ht", F.xxhash64("_huid").alias("_hmark"))
    sets = materialize(marked.mapInArrow(bodies, "_huid long, body binary").join(where, "_huid").select("_hset", "body"), "shingle-sets")

    def batches(it):
        for batch in it:
            good = [jaccard_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("_hset").alias("a"), F.col("body").alias("x")), "a").join(sets.select(F.col("_hset").alias("b"), F.col("body").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(batches, "a long, b long"), "shingle-links")


def _shared_keys(entries: DataFrame) -> DataFrame:
    """(_hset, _hn, key) of the keys that several sets have, and of few others.

    Most keys are of one set. One shuffle counts the keys alone; a bitmap of those that occur again then holds back
    the others before sets are shuffled by them.
    """
    again = entries.select(F.explode("_hkeys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    again = materialize(again, "shingle-again")
    shared = entries.sparkSession.sparkContext.broadcast(bitmap(again, "key", again.count()).tobytes())

    def batches(it):
        table = np.frombuffer(shared.value, np.uint8)
        for batch in it:
            lists = batch.column("_hkeys")
            flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            stay = passes(table, flat.view(np.uint64))
            of = np.repeat(np.arange(len(sizes)), sizes)[stay]
            yield pa.RecordBatch.from_arrays([batch.column("_hset").take(pa.array(of)), batch.column("_hn").take(pa.array(of)), pa.array(flat[stay])], names=["_hset", "_hn", "key"])

    return entries.select("_hset", "_hn", "_hkeys").mapInArrow(batches, "_hset long, _hn long, key long")


def fingerprint_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints are equal or linked by ``links``, in pairs of the least set of each fingerprint and with it."""
    prints = entries.select("_hset", F.col("_hfp").alias("fp"))
    least = materialize(prints.groupBy("fp").agg(F.min("_hset").alias("least"), F.count("*").alias("sets")), "simhash-distinct")
    equal = prints.join(least.where("sets > 1"), "fp").where("_hset <> least").select(F.col("least").alias("a"), F.col("_hset").alias("b"))
    of = lambda fp, name: least.select(F.col("fp").alias(fp), F.col("least").alias(name))
    near = links(least.select("fp")).toDF("p", "q").join(of("p", "x"), "p").join(of("q", "y"), "q")
    return equal.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def shingle_links(rows: DataFrame, entries: DataFrame, k: int, most: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of sets with a Jaccard similarity of 0.8 or more.

    Sets that fingerprints bring together are verified first; the rest is for sets that these links leave in different
    components. Sets that share a key of few meet in pairs. Those of a key of many are held against the least of them; only sets
    that are in another component then meet the sets of the key outside their own component.
    """
    first = materialize(fingerprint_pairs(entries), "simhash-pairs")
    near = _verified(first, rows, entries, k)
    group = materialize(connected_components(near), "simhash-groups")
    member = lambda c: group.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    keys = _shared_keys(entries)
    sizes = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("_hset").alias("hub")).where("m > 1")
    shared = materialize(keys.join(sizes, "key"), "shingle-shared")
    few, dense = shared.where(F.col("m") <= most), shared.where(F.col("m") > most)
    a, b = few.select("key", F.col("_hset").alias("a"), F.col("_hn").alias("p")), few.select("key", F.col("_hset").alias("b"), F.col("_hn").alias("q"))
    sized = lambda p, q: 5 * F.least(p, q) >= 4 * F.greatest(p, q)
    pairs = a.join(b, "key").where("a < b").where(sized(F.col("p"), F.col("q"))).select("a", "b")
    pairs = pairs.union(dense.where("hub <> _hset").select(F.col("hub").alias("a"), F.col("_hset").alias("b"))).distinct()
    pairs = pairs.join(first, ["a", "b"], "left_anti").join(member("a"), "a", "left").join(member("b"), "b", "left")
    pairs = materialize(pairs.where("of_a is null or of_b is null or of_a <> of_b").select("a", "b"), "shingle-pairs")
    found = near.union(_verified(pairs, rows, entries, k))
    part = materialize(connected_components(found), "shingle-parts")
    of = lambda column, to: part.select(F.col("node").alias(column), F.col("component").alias(to))
    dense = dense.join(of("_hset", "mine"), "_hset", "left").join(of("hub", "main"), "hub", "left")
    dense = materialize(dense.select("key", "_hset", "_hn", F.coalesce("mine", "_hset").alias("mine"), F.coalesce("main", "hub").alias("main")), "shingle-dense")
    out = dense.where("mine <> main").select("key", F.col("_hset").alias("a"), F.col("_hn").alias("p"), F.col("mine").alias("of_a"))
    rest = out.join(dense.select("key", F.col("_hset").alias("b"), F.col("_hn").alias("q"), F.col("mine").alias("of_b")), "key")
    rest = rest.where("of_a <> of_b").where(sized(F.col("p"), F.col("q"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = materialize(rest.join(pairs.union(first), ["a", "b"], "left_anti"), "shingle-rest")
    return found.union(_verified(rest, rows, entries, k))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5) -> DataFrame:
    """The rows of ``docs`` without those whose group has a row before them by doc_id (repeated ids: by place).

    Groups are linked by pairs whose k-word shingles have a Jaccard similarity of 0.8 or more, by fingerprints first and
    an exact join for what these leave apart; texts without words are alike.
    """
    small_batches(docs.sparkSession)
    rows = numbered(docs, "_huid")
    bodies = rows.select(F.col(doc_id).alias("_hid"), "_huid", F.col(text).cast("binary").alias("_ht"))
    with passing(docs.sparkSession):
        prints = materialize(_prefixes(bodies, k), "shingle-prints")
        first = F.min(F.struct(F.col("_hid").isNull(), "_hid", "_huid"))
        best = materialize(prints.groupBy("_hset").agg(first.alias("_hbest")), "shingle-best")
        entries = prints.join(best.select(F.col("_hbest._huid").alias("_huid")), "_huid", "left_semi").select("_hset", "_huid", "_hn", "_hkeys", "_hbits", "_hfp")
        linked = connected_components(shingle_links(bodies.select("_huid", "_ht"), materialize(entries, "shingle-entries"), k))
        linked = linked.select(F.col("node").alias("_hset"), F.col("component").alias("_hgroup"))
        kept = best.join(linked, "_hset", "left").groupBy(F.coalesce("_hgroup", "_hset")).agg(F.min("_hbest").alias("_hbest"))
        kept = materialize(kept.select(F.col("_hbest._huid").alias("_huid")), "shingle-kept", last=True)
    return rows.join(kept.hint("merge"), "_huid", "left_semi").drop("_huid")  # no broadcast of what grows with the input


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
