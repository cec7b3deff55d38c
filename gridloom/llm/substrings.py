"""Exact substring dedup: bytes in a string of ``LENGTH`` bytes that also starts anywhere else.

Every window of LENGTH bytes has an anchor, the leftmost least hash of its K-byte strings, so equal windows
have equal anchors at equal offsets. A text's windows fall into runs, one an anchor; a run is told by the
anchor's hash and the hash of all its bytes. Then:

1. anchors whose hash occurs once have no repeated window;
2. runs that occur twice or more as a whole are repeated throughout;
3. what is left are runs at the edges of copies. The distinct runs of an anchor are sorted as suffixes from
   the anchor: a mergesort whose comparisons find the common extension by binary search over prefix
   polynomial hashes. Neighbours' extensions to the right cut the order into blocks for each offset, and
   within a block runs with equal bytes to the left share a window, which is verified byte by byte.

Anchors with more than ``MOST`` distinct runs aren't sorted in one task: their windows' hashes are counted one
by one by a shuffle, which is exact as well. Texts are shuffled by row, never by content, and all joins on
content have few rows on one side of each key, so adaptive execution can split the other.

Defined results: a null text is empty; texts below LENGTH bytes keep everything and match nothing; repeated
rows repeat each other, so they go whole where they have LENGTH bytes; an empty table gives an empty result;
other columns are passed on, and helper columns start with ``_r``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import U, by_size, byte_texts, materialize, mix, numbered, prefix_hashes, small_batches, span_hashes

LENGTH = 200
K = 64
WINDOWS = LENGTH - K + 1
#: (A group of so many runs is about 5 MB.)
MOST = 16_384
#: Distinct runs that a task sorts at once, besides the last group.
_CHUNK = 8192
_LOW = U(0xFFFFFFFF)


def sliding_min(keys: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays whose minimum at (s, s + w - 1) is the least key of the window at s."""
    rows = np.concatenate([keys, np.full(-len(keys) % w, 2**64 - 1, U)]).reshape(-1, w)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return after, before


def runs(texts: list[bytes], named: bool = True) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of all bytes (of another family; if ``named``), text's place, first window, anchor's offset in it and number of windows of each run."""
    which = np.array([i for i, x in enumerate(texts) if len(x) >= LENGTH], np.int64)
    if not len(which):
        return (np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(4)))
    buf = np.frombuffer(b"".join([texts[i] for i in which]), np.uint8)
    sizes = np.array([len(texts[i]) for i in which], np.int64)
    begins = np.cumsum(sizes) - sizes
    prefix = prefix_hashes(buf)
    place = np.arange(len(buf) - K + 1)
    grams = mix(span_hashes(prefix, place, place + K))
    after, before = sliding_min((grams & ~_LOW) | place.astype(U), WINDOWS)
    doc = np.repeat(np.arange(len(which)), sizes - LENGTH + 1)
    s = np.arange(len(doc)) + (doc * (LENGTH - 1))
    anchor = (np.minimum(after[s], before[s + WINDOWS - 1]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    n = np.diff(np.r_[first, len(doc)])
    lo, at, of = s[first], anchor[first], doc[first]
    view = memoryview(buf)
    whole = np.array([xxh3_64_intdigest(view[a:b]) for a, b in zip(lo.tolist(), (lo + n - 1 + LENGTH).tolist())] if named else np.zeros(len(lo)), U)
    whole = whole ^ mix(((at - lo) << 20 | n).astype(U))
    return grams[at], whole, which[of], lo - begins[of], at - lo, n


class Suffixes:
    """Suffixes of a buffer from given places to given ends, compared by hashes of their prefixes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.buf, self.start, self.end, self.prefix = buf, start, end, prefix_hashes(buf)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, by binary search."""
        a, b = self.start[i], self.start[j]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.end[i] - a, self.end[j] - b)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = span_hashes(self.prefix, a, a + mid) == span_hashes(self.prefix, b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j; equal ones by number."""
        n = self.common(i, j)
        over_i, over_j = self.start[i] + n >= self.end[i], self.start[j] + n >= self.end[j]
        last = len(self.buf) - 1
        by_byte = self.buf[np.minimum(self.start[i] + n, last)] < self.buf[np.minimum(self.start[j] + n, last)]
        return np.where(over_i & over_j, i < j, np.where(over_i, True, np.where(over_j, False, by_byte)))


def sort_groups(suffixes: Suffixes, group_start: np.ndarray, group_end: np.ndarray) -> np.ndarray:
    """Mergesort of the suffixes within their (contiguous) groups, all groups at once; returns the order."""
    order = np.arange(len(group_start))
    width = 1
    while width < (group_end - group_start).max(initial=1):
        q = np.arange(len(order)) - group_start
        block = group_start + q // (2 * width) * (2 * width)
        middle = np.minimum(block + width, group_end)
        stop = np.minimum(block + 2 * width, group_end)
        in_left = q % (2 * width) < width
        lo, hi = np.where(in_left, middle, block), np.where(in_left, stop, middle)
        base = lo.copy()
        while (todo := np.flatnonzero(lo < hi)).size:
            mid = (lo[todo] + hi[todo]) >> 1
            me, other = order[todo], order[mid]
            before = suffixes.less(other, me)  # numbers break ties, so this serves both sides
            lo[todo], hi[todo] = np.where(before, mid + 1, lo[todo]), np.where(before, hi[todo], mid)
        own = np.arange(len(order)) - np.where(in_left, block, middle)
        merged = np.empty_like(order)
        merged[block + own + lo - base] = order
        order = merged
        width *= 2
    return order


def shared_windows(group: np.ndarray, bodies: list[bytes], offset: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """For each distinct run (rows in order of group): the windows that another run of its group has at the same offset."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    base = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    anchor = base + offset
    s = Suffixes(buf, anchor, base + sizes)
    new = np.r_[True, group[1:] != group[:-1]]
    begin = np.flatnonzero(new)
    stop = np.r_[begin[1:], len(group)]
    at = np.repeat(np.arange(len(begin)), stop - begin)
    order = sort_groups(s, begin[at], stop[at])
    right = np.zeros(len(order), np.int64)
    right[1:] = s.common(order[:-1], order[1:])
    right[new] = -1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for o in range(WINDOWS):
        block = np.cumsum(right < LENGTH - o)
        has = (offset[order] >= o) & (offset[order] - o < n[order])
        me, where = order[has], block[has]
        if len(me) < 2:
            continue
        left = mix(span_hashes(s.prefix, anchor[me] - o, anchor[me])) ^ mix(where.astype(U))
        by = np.argsort(left, kind="stable")
        same = np.flatnonzero(left[by][1:] == left[by][:-1])
        if not len(same):
            continue
        a, b = me[by[same]], me[by[same + 1]]
        cells = np.arange(LENGTH)
        for i in range(0, len(a), 4096):
            x, y = a[i : i + 4096], b[i : i + 4096]
            true = (buf[(anchor[x] - o)[:, None] + cells] == buf[(anchor[y] - o)[:, None] + cells]).all(1)
            both = np.unique(np.concatenate([x[true], y[true]]))
            found.append((both, offset[both] - o))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(bodies)
    if found:
        who, window = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((window, who))
        who, window = who[by], window[by]
        for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(who)) + 1):
            out[who[part[0]]] = np.unique(window[part])
    return out


def intervals(windows: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of each unbroken row of sorted window numbers."""
    if not len(windows):
        return []
    parts = np.split(windows, np.flatnonzero(np.diff(windows) > 1) + 1)
    return [(int(p[0]), len(p)) for p in parts]


def _table(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def _run_rows(docs: DataFrame, counted: bool) -> DataFrame:
    """A row for each run: h, c, uid, loc (first window, offset and number of windows); or h and its count by batch."""

    def batches(it):
        for batch in it:
            data, uid = byte_texts(batch.column("text")), batch.column("uid").to_numpy()
            for a, b in by_size(data):
                h, c, doc, lo, at, n = runs(data[a:b], not counted)
                if counted:
                    h, n = np.unique(h, return_counts=True)
                    yield _table([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])
                else:
                    yield _table([pa.array(x) for x in (h.view(np.int64), c.view(np.int64), uid[a:b][doc], lo << 16 | at << 8 | n)], ["h", "c", "uid", "loc"])

    return docs.mapInArrow(batches, "h long, n long" if counted else "h long, c long, uid long, loc long")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(uid, spans) for rows of (uid, text binary) that have a repeated window; spans are (start, length) pairs."""
    seen = _run_rows(rows, True).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    seen = materialize(seen, "substring-anchors")
    members = materialize(_run_rows(rows, False).join(seen, "h", "left_semi"), "substring-runs")
    whole = members.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("uid", "loc")).alias("one"))
    whole = materialize(whole, "substring-distinct")
    first, offset, n = F.shiftright("loc", 16), F.shiftright("loc", 8).bitwiseAND(F.lit(255)), F.col("loc").bitwiseAND(F.lit(255))
    copied = members.join(whole.where("n > 1").select("h", "c"), ["h", "c"]).select("uid", first.alias("start"), (n - 1 + LENGTH).alias("length"))

    mixed = whole.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("h", "k")
    edge = whole.join(mixed, "h").select("h", "c", F.col("one.uid").alias("uid"), F.col("one.loc").alias("loc"), (F.col("n") == 1).alias("lone"), "k")
    edge = edge.select("uid", F.struct("h", first.alias("lo"), offset.alias("at"), n.alias("n"), "lone", (F.col("k") > MOST).alias("many")).alias("run"))
    wanted = rows.join(edge.groupBy("uid").agg(F.collect_list("run").alias("runs")), "uid")
    bodies = materialize(wanted.mapInArrow(_bodies, "h long, w long, uid long, lo long, at int, n int, lone boolean, body binary"), "substring-edges")

    few = bodies.where("body IS NOT NULL").repartition("h").sortWithinPartitions("h")
    sorted_out = few.mapInArrow(_shared, "uid long, start long, length long")
    each = bodies.where("body IS NULL").select("h", "w", "uid", "lo", "lone")
    twice = each.groupBy("h", "w").agg(F.count("*").alias("k")).where("k > 1").select("h", "w")
    counted = each.where("lone").join(twice, ["h", "w"]).select("uid", F.col("lo").alias("start"), F.lit(LENGTH).cast("long").alias("length"))
    found = copied.union(sorted_out).union(counted)
    return found.groupBy("uid").agg(F.collect_list(F.struct("start", "length")).alias("spans"))


def _bodies(it):
    """The bytes of wanted runs; of anchors with very many runs, the hash of each window instead."""
    names = ["h", "w", "uid", "lo", "at", "n", "lone", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    for batch in it:
        out: list[tuple] = []
        for uid, text, wanted in zip(batch.column("uid").to_pylist(), byte_texts(batch.column("text")), batch.column("runs").to_pylist()):
            for r in wanted:
                lo, n = r["lo"], r["n"]
                body = text[lo : lo + n - 1 + LENGTH]
                if not r["many"]:
                    out.append((r["h"], None, uid, lo, r["at"], n, r["lone"], body))
                else:
                    s = np.arange(n)
                    hashes = mix(span_hashes(prefix_hashes(np.frombuffer(body, np.uint8)), s, s + LENGTH)) ^ mix(((r["at"] - s) + 1).astype(U))
                    out += [(r["h"], int(w), uid, lo + i, None, None, r["lone"], None) for i, w in enumerate(hashes.view(np.int64))]
            if len(out) > 4096:
                yield _table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield _table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _shared(it):
    """Spans of windows that runs of an anchor share, from rows in order of h."""
    held: pa.Table | None = None

    def solve(t: pa.Table):
        h, at, n = (t.column(c).to_numpy() for c in ("h", "at", "n"))
        lone, uid, lo = t.column("lone").to_pylist(), t.column("uid").to_pylist(), t.column("lo").to_pylist()
        out = []
        for i, windows in enumerate(shared_windows(h, t.column("body").to_pylist(), at.astype(np.int64), n.astype(np.int64))):
            if lone[i]:
                out += [(uid[i], lo[i] + a, k - 1 + LENGTH) for a, k in intervals(windows)]
        if out:
            yield _table([pa.array(c, pa.int64()) for c in zip(*out)], ["uid", "start", "length"])

    for batch in it:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= _CHUNK:
            h = held.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield from solve(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from solve(held)


def cut(text: bytes, spans: list) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, as (start, end), and the bytes that stay."""
    merged: list[list[int]] = []
    for a, b in sorted((s["start"], s["start"] + s["length"]) for s in spans or []):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, end = [], 0
    for a, b in merged:
        kept.append(text[end:a])
        end = b
    return [(a, b) for a, b in merged], b"".join([*kept, text[end:]])


def strip_repeats(docs: DataFrame, text: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` without the text and with n_bytes, n_removed and n_spans, and the bytes that stay: kept (binary) or kept_sha256."""
    small_batches(docs.sparkSession)
    last = "kept_sha256" if digest else "kept"
    made = ["n_bytes", "n_removed", "n_spans", last]
    names = [c for c in docs.columns if c != text and c not in made]
    rows = numbered(docs.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(names)], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")), "uid")
    spans = repeated_spans(rows.select("uid", "text"))
    joined = rows.join(spans, "uid", "left").drop("uid")
    passed = [f"_r{i}" for i in range(len(names))]
    schema = joined.select(*passed, *[F.lit(0).cast("long").alias(c) for c in made[:3]], F.lit("" if digest else b"").alias(last)).schema

    def batches(it):
        for batch in it:
            out = []
            for body, found in zip(byte_texts(batch.column("text")), batch.column("spans").to_pylist()):
                gone, kept = cut(body, found)
                out.append((len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest() if digest else kept))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            kinds = [pa.int64()] * 3 + [pa.string() if digest else pa.binary()]
            yield _table([*(batch.column(c) for c in passed), *(pa.array(c, k) for c, k in zip(columns, kinds))], schema.names)

    return joined.mapInArrow(batches, schema).select(*[F.col(f"_r{i}").alias(c) for i, c in enumerate(names)], *made)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return strip_repeats(docs, digest=True)
