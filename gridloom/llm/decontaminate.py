"""Benchmark decontamination by spaced seeds.

A seed hash covers fixed positions of a span of words and ignores the others, so a substituted word at an
ignored position doesn't hide a passage. The hashes of benchmark items are joined with those of documents;
around each hit, item and document are laid side by side at the hit's offset. A document is contaminated by
an item if some stretch there of ``LEAST`` words or more, or all of a shorter item, has at least 0.8 matching
words. The stretch with the best score (a match counts 1, a mismatch -4) is reported if it is that long, and
the longest that qualifies otherwise.

No such stretch of substitutions escapes the seeds: one of 24 words or more has a half that qualifies, and a
shorter one starts with 12 words of which at most 2 differ, 15 of which 3 do, or 20 of which 4 do; ``SEEDS``
hit all of these. ``SHORT`` hit all items of 6 to 11 words of which 0.8 match.

Documents pass a bitmap of the item hashes first (sized by their number, 16 MB at most); only documents with a
possible hit leave the first pass, with the hashes of their words. A benchmark too large for the bitmap lets
more documents pass, and the joins decide as before. An item that very many documents hold is the skewed
left side of an equi-join, which adaptive execution splits.

A hash that a text or an item repeats is one row with all its places, so repetitive texts don't multiply: a
document meets an item in one row, which has the words of both and the places of the hashes that they share. There
the offsets are marked in a bit for each, and many offsets are compared at a time.

Words are lower-case runs of letters and digits. Defined results: null and empty texts and items match
nothing; an item of fewer than ``SPAN`` words counts where all its words follow each other, and only if it has
``shortest`` words (1 in a report; ``SPAN`` where documents are dropped, as fewer can't be told from common phrases);
repeated rows are reported each; empty tables give an empty result; helper columns start with ``_c``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, bitmap, by_size, lower_bytes, materialize, mix, numbered, passes, passing, small_batches, word_hashes

#: Positions that each seed covers; together they hit every stretch of 12 words with 2 substitutions, 15 with 3 or 20 with 4.
SEEDS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 5, 6, 7), (0, 1, 2, 6, 8, 9), (0, 1, 2, 4, 6, 7))
#: The same for items below ``LEAST`` words: 6 to 9 words with one substitution, 10 or 11 with 2.
SHORT = ((0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 2, 3, 5), (0, 1, 2, 3, 6))
#: Words of the shortest item in which substitutions are allowed, and the seeds for shorter ones by their words.
SPAN = 6
WHOLE = tuple(tuple(range(n)) for n in range(1, SPAN))
LEAST = 12
MISMATCH = 4
_ODD = [U(x | 1) for x in np.random.default_rng(9).integers(0, 2**63, 16, dtype=np.int64).tolist()]


def seed_hashes(words: np.ndarray, counts: np.ndarray, tiny: tuple[int, ...] = ()):
    """For each seed, those of ``tiny`` items included: (its number, places, hashes) of all spans that lie within one text."""
    ends = np.repeat(np.cumsum(counts), counts)
    for number, seed in enumerate(SEEDS + SHORT + WHOLE):
        if number >= len(SEEDS + SHORT) and len(seed) not in tiny:
            continue
        n = max(0, len(words) - seed[-1])
        total = np.full(n, number + 1, U)
        for k, o in enumerate(seed):
            total = total + words[o : o + n] * _ODD[k]
        places = np.flatnonzero(np.arange(n) + seed[-1] < ends[:n])
        yield number, places, mix(total[places])


def _by_hash(owner: np.ndarray, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Owner, hash and list of places of each hash of an owner."""
    order = np.lexsort((place, h, owner))
    owner, place, h = owner[order], place[order], h[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(h)], pa.int32()), pa.array(place, pa.int32()))
    return owner[first], h[first].view(np.int64), lists


def item_seeds(items: DataFrame, shortest: int = 1) -> DataFrame:
    """(h, item, size, ats): seed hashes of rows of (item, text), their places, and the item's number of words."""

    def batches(it):
        for batch in it:
            words, counts = word_hashes(lower_bytes(batch.column("text")))
            counts_all = np.where(counts >= shortest, counts, 0)
            words = words[np.repeat(counts >= shortest, counts)]
            owner = np.repeat(np.arange(len(counts)), counts_all)
            begins = np.repeat(np.cumsum(counts_all) - counts_all, counts_all)
            size = np.repeat(counts_all, counts_all)
            rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))]
            for number, places, h in seed_hashes(words, counts_all, tuple(range(1, SPAN))):
                n = size[places]
                kind = number - len(SEEDS + SHORT) + 1
                mine = n == kind if kind > 0 else (n >= LEAST) if number < len(SEEDS) else (n >= SPAN) & (n < LEAST)
                places, h = places[mine], h[mine]
                rows.append((owner[places], places - begins[places], h))
            of, h, ats = _by_hash(*map(np.concatenate, zip(*rows)))
            item = batch.column("item").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(item[of]), pa.array(counts[of]), ats], names=["h", "item", "size", "ats"])

    return items.mapInArrow(batches, "h long, item long, size long, ats array<int>")


def _words_of(rows: DataFrame, key: str) -> DataFrame:
    def batches(it):
        for batch in it:
            words, counts = word_hashes(lower_bytes(batch.column("text")))
            parts = np.split(words, np.cumsum(counts)[:-1]) if len(counts) else []
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([p.tobytes() for p in parts], pa.binary())], names=[key, "words"])

    return rows.select(key, "text").mapInArrow(batches, f"{key} long, words binary")


def possible(docs: DataFrame, bits: np.ndarray, tiny: tuple[int, ...] = ()) -> DataFrame:
    """(uid, words, hits) of the rows of (uid, text) that have a seed hash in the bitmap; hits are (h, places)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def batches(it):
        table = np.frombuffer(shared.value, np.uint8)
        for batch in it:
            uid, data = batch.column("uid").to_pylist(), lower_bytes(batch.column("text"))
            for a, b in by_size(data):
                words, counts = word_hashes(data[a:b])
                ends = np.cumsum(counts)
                rows = []
                for _, places, h in seed_hashes(words, counts, tiny):
                    hit = passes(table, h)
                    rows.append((places[hit], h[hit]))
                at, h = map(np.concatenate, zip(*rows))
                if not len(at):
                    continue
                doc = np.searchsorted(ends, at, "right")
                of, h, places = _by_hash(doc, at - ends[doc] + counts[doc], h)
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                hits = pa.ListArray.from_arrays(pa.array(np.r_[first, len(of)], pa.int32()), pa.StructArray.from_arrays([pa.array(h), places], ["h", "places"]))
                found = of[first].tolist()
                bodies = [words[ends[d] - counts[d] : ends[d]].tobytes() for d in found]
                yield pa.RecordBatch.from_arrays([pa.array([uid[a + d] for d in found], pa.int64()), pa.array(bodies, pa.binary()), hits], names=["uid", "words", "hits"])

    return docs.mapInArrow(batches, "uid long, words binary, hits array<struct<h:long,places:array<int>>>")


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """(first word in the document, in the item, words, matches) of the best stretch with item word j at document word j + shift.

    Where the stretch with the best score is too short, the longest with at least 0.8 matching words (the first of these).
    """
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if a >= b:
        return 0, 0, 0, 0
    same = doc[a + shift : b + shift] == item[a:b]
    total = np.r_[0, np.cumsum(np.where(same, 1, -MISMATCH))]
    gain = total - np.minimum.accumulate(total)
    stop = int(gain.argmax())
    start = int(stop - 1 - total[:stop][::-1].argmin()) if stop else 0
    if stop - start < min(LEAST, len(item)):
        begin = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
        size = np.arange(len(total)) - begin
        stop = int(size.argmax())
        start = int(begin[stop])
    return a + start + shift, a + start, stop - start, int(same[start:stop].sum())


def offsets(doc: int, item: int, shared: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The distinct offsets at which places of a document (of ``doc`` words) and an item that share a hash meet, in order."""
    mark = np.zeros(doc + item + 1, bool)
    for places, ats in shared:
        few, many = (ats, places) if len(ats) <= len(places) else (places, ats)
        for x in few.tolist():
            mark[(many - x if few is ats else x - many) + item] = True
    return np.flatnonzero(mark) - item


def best_of(doc: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int, int] | None:
    """The contaminating stretch with most matches, the first of these, over all offsets (in order); None where there is none.

    Offsets at which the item lies within the document are compared many at a time. Once all words of the item match,
    no later offset has more.
    """
    m, least = len(item), min(LEAST, len(item))
    best: tuple | None = None

    def take(a: int, b: int, n: int, same: int) -> None:
        nonlocal best
        if n >= least and (best is None or (same, -a, b, n) > best):
            best = (same, -a, b, n)

    whole = (shifts >= 0) & (shifts + m <= len(doc))
    for shift in shifts[shifts < 0].tolist():
        take(*best_overlap(doc, item, shift))
    rows = shifts[whole]
    for start in range(0, len(rows), most := max(1, (1 << 18) // m)):
        if best is not None and best[0] == m:
            break
        some = rows[start : start + most]
        same = doc[some[:, None] + np.arange(m)] == item
        matches = same.sum(1)
        able = np.flatnonzero(5 * matches >= 4 * least)
        if not len(able):
            continue
        some, same, matches = some[able], same[able], matches[able]
        total = np.zeros((len(some), m + 1), np.int64)
        np.cumsum(np.where(same, 1, -MISMATCH), axis=1, out=total[:, 1:])
        low = np.minimum.accumulate(total, axis=1)
        stop = (total - low).argmax(1)
        last = np.maximum.accumulate(np.where(total == low, np.arange(m + 1), 0), axis=1)
        line = np.arange(len(some))
        begin = np.where(stop > 0, last[line, np.maximum(stop - 1, 0)], 0)
        upto = np.zeros((len(some), m + 1), np.int64)
        np.cumsum(same, axis=1, out=upto[:, 1:])
        n, got = stop - begin, upto[line, stop] - upto[line, begin]
        long = np.flatnonzero(n >= least)
        if len(long):
            top = long[np.lexsort((some[long] + begin[long], -got[long]))]
            top = top[(got[top] == got[top[0]]) & (some[top] + begin[top] == some[top[0]] + begin[top[0]])]
            for i in top.tolist():
                take(int(some[i] + begin[i]), int(begin[i]), int(n[i]), int(got[i]))
        for i in np.flatnonzero(n < least).tolist():
            if best is None or matches[i] >= best[0]:
                take(*best_overlap(doc, item, int(some[i])))
    if best is None or best[0] < m:
        for shift in shifts[(shifts >= 0) & ~whole].tolist():
            take(*best_overlap(doc, item, shift))
    return None if best is None else (-best[1], best[2], best[3], best[0])


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", uid: str = "_cuid", shortest: int = 1) -> DataFrame:
    """(uid, item_id, doc_word, item_word, n_words, n_match, similarity) of each contaminating pair, its best stretch."""
    small_batches(docs.sparkSession)
    bench = numbered(items.select(F.col(item_id).alias("name"), F.col(item_text).alias("text")).where("text IS NOT NULL"), "item")
    seeds = materialize(item_seeds(bench.select("item", "text"), shortest), "bench-seeds")
    tiny = tuple(r.size for r in seeds.where(F.col("size") < SPAN).select("size").distinct().collect())
    bits = bitmap(seeds.select("h").distinct(), "h", seeds.count())
    found = materialize(possible(docs.select(F.col(uid).alias("uid"), F.col(text).alias("text")), bits, tiny), "bench-possible")
    hits = found.select("uid", F.inline("hits")).join(seeds, "h")
    hits = hits.groupBy("uid", "item").agg(F.collect_list(F.struct("places", "ats")).alias("shared"))
    named = _words_of(bench, "item").withColumnRenamed("words", "item_words").join(bench.select("item", "name"), "item")
    pairs = hits.join(named, "item").join(found.select("uid", "words"), "uid").select("uid", "item", "name", "words", "item_words", "shared")
    kind = "uid long, item long, name long, doc_word long, item_word long, n_words long, n_match long"

    def batches(it):
        for batch in it:
            out = []
            for u, i, name, w, v, shared in zip(*(batch.column(c) for c in batch.schema.names)):
                doc, item = np.frombuffer(w.as_py(), U), np.frombuffer(v.as_py(), U)
                places, ats = (shared.values.field(c) for c in ("places", "ats"))
                both = [(p.values.to_numpy(), a.values.to_numpy()) for p, a in zip(places, ats)]
                best = best_of(doc, item, offsets(len(doc), len(item), both))
                if best is not None:
                    out.append((u.as_py(), i.as_py(), name.as_py(), *best))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["uid", "item", "name", "doc_word", "item_word", "n_words", "n_match"])

    best = pairs.mapInArrow(batches, kind)
    return best.select(F.col("uid").alias(uid), F.col("name").alias(item_id), "doc_word", "item_word", "n_words", "n_match", F.round(F.col("n_match") / F.col("n_words"), 6).alias("similarity"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The pairs of overlaps() with doc_id."""
    rows = numbered(docs.select(F.col(doc_id).alias("_cid"), "text"), "_cuid")
    with passing(docs.sparkSession):
        found = materialize(overlaps(rows, items), "bench-found", last=True)
    return rows.select("_cid", "_cuid").join(found, "_cuid").drop("_cuid").withColumnRenamed("_cid", doc_id)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item of ``SPAN`` words or more contaminates."""
    rows = numbered(docs, "_cuid")
    with passing(docs.sparkSession):
        found = materialize(overlaps(rows, items, shortest=SPAN).select("_cuid").distinct(), "bench-found", last=True)
    return rows.join(found, "_cuid", "left_anti").drop("_cuid")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: doc_id, item_id and the verified overlap."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
