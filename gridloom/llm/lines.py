"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line kept a group.

A normalised line is lower case, digits as 0, and its words joined by single spaces; lines without a word are
never removed. Equal normalised lines are one entry, told by a 128-bit hash.

A line's fingerprint has ``blocks(n)`` blocks of 64 bits for its n words. Each distinct word votes in the block that its
hash picks, so a replaced word alters two blocks at most and all others still agree (pigeonhole). Lines near a
change of ``blocks`` have the blocks of both sides. A key is a block, with as many of the blocks after it as give
it three distinct words (half of a shorter line's words); lines below ``SHORT`` words have each pair of blocks.
All lines that share a key meet, whatever their number: they are candidates if half of a 128-bit SimHash of word pairs
differs in ``RADIUS`` bits or fewer. Candidates whose whole SimHash is within twice ``RADIUS`` bits are verified by edit
similarity (``SIMILARITY``), and verified pairs link lines to groups. Of each group's lines the first stays, by
document id and place.

Copies aren't expanded into all pairs, and yet the groups are those of all pairs: of a key's lines each meets a leader
first; then the lines of keys that still hold several groups are laid out in squares with their texts, and all of a
square's lines meet in one task. It verifies those in different groups, the nearest first, joins the groups that a link
unites, and gives out these links only: fewer than the square has lines, however many pairs are near. Two lines meet in
the first square's key that they share. The keys travel in arrays, dealt by their first bits. A key's lines pass
through one task with 24 bytes each; a square has up to twice ``TILE`` lines and ``_CHARS`` characters, or two lines.

Edits near the limit that touch every block leave no candidate; README has measured recall. Defined results:
null and empty texts have one line without a word, which stays; a line of any length is compared whole; characters
of three or more bytes in UTF-8 count as words; repeated rows lose all their lines but the first's; an empty table
gives an empty result; other columns are passed on, and helper columns start with ``_l``. A line in very many
documents is the skewed left side of a join on the line, which adaptive execution splits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import combinations, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, WORD_BYTE, bitmap, by_size, connected_components, lower_bytes, materialize, mix, numbered, passes, passing, prefix_hashes, small_batches, span_hashes, texts

#: Lines of fewer words have pairs of blocks as keys.
SHORT = 12
#: A line this much shorter than a step of ``blocks`` has the blocks of the next step too.
OVER = 1.1
#: Distinct words that a key holds at least.
LEAST = 3
RADIUS = 20
SIMILARITY = 0.8

_class = np.where(WORD_BYTE, np.arange(256), 32).astype(np.uint8)
_class[ord("0") : ord("9") + 1] = ord("0")
_class[10] = 10
#: For each byte, its bits as eight counters of eight bits each.
_lanes = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(U) << (U(8) * np.arange(8, dtype=U))).sum(1, dtype=U)
_ODD = U(0xD6E8FEB86659FD93)
_WORD = U((1 << 40) - 1)
#: Lines whose hashes a task keeps, so that their keys come out once; beyond, it starts afresh.
_SEEN = 1 << 20
#: Lines of a key that are compared in one task.
TILE = 2048
#: Leaders of a key of more lines; others wait until those of other groups meet.
_LEADERS = 64
#: Characters of a key's lines in one side of a square, about.
_CHARS = 1 << 24
#: Lines of each other group that a line meets before it meets all of them.
_NEAREST = 3
#: Keys that a task holds before it deals them, and keys of a bucket, about.
_HELD = 1 << 20
_BUCKET = 1 << 17
#: Columns between two looks at the diagonal, and the distance of the cells looked at, at least.
_LOOK = 40
_STEP = 8
#: Strings up to this length are compared without a bound first.
_DIRECT = 60
#: What lies between two words is compared exactly if its lengths' product is at most this.
_SMALL = 40_000


def normalise(data: list[bytes]) -> np.ndarray:
    """The normalised lines of all texts as one buffer, each between two newlines."""
    buf = _class[np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8)]
    gap = (buf == 32) | (buf == 10)
    begins = gap & ~np.r_[False, gap[:-1]]
    run = np.cumsum(begins)
    broken = np.zeros(run[-1] + 1, bool)
    broken[run[buf == 10]] = True
    return buf[~gap | (buf == 10) | (begins & ~broken[run])]


def split_lines(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text's place, line number, start and end (in the normalised buffer) of lines with a word; and the buffer."""
    buf = normalise(data)
    newline = np.flatnonzero(buf == 10)
    start, end = newline[:-1] + 1, newline[1:]
    counts = np.array([x.count(b"\n") + 1 for x in data])
    doc = np.repeat(np.arange(len(data)), counts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    real = end > start
    return doc[real], number[real], start[real], end[real], buf


def line_names(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 128-bit hash of each line, as two signed integers."""
    from xxhash import xxh3_128_digest

    view = memoryview(buf.tobytes())
    return np.frombuffer(b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())]), "<i8").reshape(-1, 2)


def majority(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes: the bits that over half of them have."""
    pieces = -(-counts // 255)
    of = np.repeat(np.arange(len(counts)), pieces)
    at = first[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    bits = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.stack([np.add.reduceat(_lanes[bits[:, b]], at).view(np.uint8).reshape(-1, 8) for b in range(8)], 1).reshape(-1, 64)
    total = ones.astype(np.int32)
    if len(of) > len(counts):
        total = np.add.reduceat(total, np.cumsum(pieces) - pieces, axis=0)
    return np.packbits(2 * total > counts[:, None], axis=1, bitorder="little").view(U).ravel()


def blocks(n: np.ndarray) -> np.ndarray:
    """Blocks of lines of n words: 6 below ``SHORT``, 7 to twice that, then 8, and twice as many for each fourfold number of words."""
    more = 8 << np.maximum(0, np.floor(np.log2(np.maximum(n, 1) / (2 * SHORT)) / 2)).astype(np.int64)
    return np.where(n < SHORT, 6, np.where(n < 2 * SHORT, 7, more))


def _ring(key: np.ndarray, distinct: np.ndarray, base: np.ndarray, size: np.ndarray, least: np.ndarray):
    """(line, key) of the keys that start at each block with a word; equal ones of a line once.

    Lines of six blocks have each pair of blocks instead, so two replaced words always leave one of their keys.
    """
    line = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(key)) - base[line]
    run, have, length = key.copy(), distinct.copy(), np.ones(len(key), np.int64)
    todo = np.flatnonzero((distinct > 0) & (have < least[line]))
    step = 1
    while len(todo):
        at = base[line[todo]] + (place[todo] + step) % size[line[todo]]
        run[todo] = mix(run[todo] + key[at] * _ODD)
        have[todo] += distinct[at]
        length[todo] = step = step + 1
        todo = todo[(have[todo] < least[line[todo]]) & (step < size[line[todo]])]
    whole = length == size[line]
    total = np.add.reduceat(key, base) if len(base) else key
    run = np.where(whole, mix(total[line]), run)
    starts = distinct > 0
    first_whole = np.zeros(len(key), bool)
    if whole.any():
        first_whole[np.flatnonzero(whole & starts)[np.unique(line[whole & starts], return_index=True)[1]]] = True
    keep = starts & (~whole | first_whole) & (size[line] > 6)
    out = [(line[keep], run[keep])]
    short = base[size == 6]
    words = np.add.reduceat(distinct, base)[size == 6]
    for i, j in combinations(range(6), 2):
        pair = mix(mix(key[short + i] + U(6 * i + j)) + key[short + j] * _ODD)
        full = distinct[short + i] + distinct[short + j] >= np.minimum(2, -(-words // 3))
        out.append((line[short][full], pair[full]))
    return tuple(np.concatenate(x) for x in zip(*out))


def line_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash and line of all words of lines of a normalised buffer, and the number of words of each line."""
    gap = (buf == 32) | (buf == 10)
    begins = ~gap & (np.r_[True, gap[:-1]] | (buf >= 0xE0))
    stops = np.flatnonzero(gap | begins)
    at = np.flatnonzero(begins[stops])
    words, stop = stops[at], stops[at + 1]
    first = np.searchsorted(words, start)
    n = np.searchsorted(words, end) - first
    if n.sum() != len(words):
        mine = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        words, stop = words[mine], stop[mine]
    return mix(span_hashes(prefix_hashes(buf), words, stop)), np.repeat(np.arange(len(start)), n), n


def prints_of(h: np.ndarray, n: np.ndarray, half: int) -> np.ndarray:
    """Half 1 or 2 of the 128-bit SimHash of each line's word pairs, and words below ``SHORT``; every line has a word."""
    last = np.cumsum(n) - 1
    both = np.empty((len(h), 2), U)
    both[:, 0], both[:, 1] = mix(np.r_[h[1:], h[:1]] * _ODD + h), h
    both[last, 0] = h[last]
    short = n < SHORT
    counts = n * (1 + short)
    used = np.ones((len(h), 2), bool)
    used[:, 1] = np.repeat(short, n)
    return majority(mix(both[used] + U(half)), np.cumsum(counts) - counts, counts)


def signatures(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """For lines of a normalised buffer: half the SimHash of each, and (line, key) of their keys, in order of lines."""
    h, line, n = line_words(buf, start, end)
    prints = prints_of(h, n, 1)
    rows = []
    size, longer = blocks(n), blocks(np.ceil(n * OVER))
    for size in (size, np.where(longer != size, longer, 0)):
        some = np.flatnonzero(size)
        if not len(some):
            continue
        number = np.full(len(size), -1)
        number[some] = np.arange(len(some))
        w = np.flatnonzero(size[line]) if len(some) < len(size) else slice(None)
        size, word, of = size[some], h[w], number[line[w]]
        base = np.cumsum(size) - size
        cell = base[of].astype(U) + ((mix(word + U(5)) >> U(32)) * size[of].astype(U) >> U(32))
        both = np.sort(cell << U(40) | word >> U(24))
        both = both[np.r_[True, both[1:] != both[:-1]]]
        cell = (both >> U(40)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        counts = np.diff(np.r_[first, len(cell)])
        key, distinct = np.zeros(size.sum(), U), np.zeros(size.sum(), np.int64)
        key[cell[first]], distinct[cell[first]] = majority(mix(both & _WORD), first, counts), counts
        place = np.arange(len(key)) - np.repeat(base, size)
        key = mix(key ^ (np.repeat(size, size) << 32 | place).astype(U) * _ODD)
        total = np.add.reduceat(distinct, base)
        at, run = _ring(key, distinct, base, size, np.minimum(LEAST, -(-total // 2)))
        rows.append((some[at], run))
    at, run = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros(0, U))
    order = np.argsort(at, kind="stable")
    return prints, at[order], run[order]


def line_rows(rows: DataFrame) -> DataFrame:
    """(id, uid, line, h, g) for each line with a word of rows of (id, uid, text), and once a task of equal lines fp and keys. No shuffle."""

    def batches(it):
        seen: set[int] = set()
        for batch in it:
            data, uid = lower_bytes(batch.column("text")), batch.column("uid").to_numpy()
            for a, b in by_size(data):
                doc, number, start, end, buf = split_lines(data[a:b])
                name = line_names(buf, start, end)
                h = name[:, 0].tolist()
                if len(seen) > _SEEN:
                    seen.clear()
                once = np.array([i for i, x in enumerate(h) if x not in seen and not seen.add(x)], np.int64)
                prints, at, key = signatures(buf, start[once], end[once])
                fp, is_once, sizes = np.zeros(len(doc), np.int64), np.zeros(len(doc), bool), np.zeros(len(doc), np.int64)
                fp[once], is_once[once] = prints.view(np.int64), True
                sizes[once] = np.bincount(at, minlength=len(once))
                keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(key.view(np.int64)))
                columns = [batch.column("id").take(pa.array(a + doc)), *(pa.array(np.ascontiguousarray(x)) for x in (uid[a:b][doc], number, name[:, 0], name[:, 1]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(fp, mask=~is_once), keys], names=["id", "uid", "line", "h", "g", "fp", "keys"])

    return rows.mapInArrow(batches, "id long, uid long, line long, h long, g long, fp long, keys array<long>")


def dealt(it, bits: int):
    """From rows (h, fp, keys): for each bucket of the keys' first bits the keys, hashes and SimHashes as arrays."""
    held, n = [], 0

    def table():
        keys, h, fp = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys.view(U))
        bucket = (keys[order].view(U) >> U(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        cuts = pa.array(np.r_[first, len(bucket)], pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order])) for x in (keys, h, fp)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *lists], names=["bucket", "keys", "h", "fp"])

    for batch in it:
        lists = batch.column("keys")
        sizes = np.diff(lists.offsets.to_numpy())
        held.append((lists.flatten().to_numpy(), np.repeat(batch.column("h").to_numpy(), sizes), np.repeat(batch.column("fp").to_numpy(), sizes)))
        n += sizes.sum()
        if n >= _HELD:
            yield table()
            held, n = [], 0
    if n:
        yield table()


def runs(it, *names: str):
    """The batches of sorted rows, cut where the named columns change: a list of pieces for each of their values."""
    held, last = [], None
    for batch in it:
        at = np.stack([batch.column(c).to_numpy() for c in names], 1)
        for a, b in pairwise([0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]):
            if a == b:
                continue
            value = at[a].tolist()
            if held and value != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = value
    if held:
        yield held


def _same_keys(key: np.ndarray, h: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows, without repeated ones, of keys that several lines have, in order of key and h; and where each key starts."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    order = order[(np.r_[False, same] | np.r_[same, False])[: len(order)]]
    order = order[np.lexsort((h[order], key[order]))]
    key, h = key[order], h[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])][: len(key)]
    key, h, fp = key[new], h[new], fp[order][new].view(U)
    return key, h, fp, np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, None] ^ y[None, :]) <= RADIUS


def stars(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (leader, place) of a key's lines, and the places of lines that may be near others than their leader."""
    m, leaders, members = len(fp), [], []
    if m > TILE:
        free = np.arange(m)
        for _ in range(_LEADERS):
            if len(free) < 2:
                break
            near = _near(free_fp := fp[free], free_fp[:1])[:, 0]
            members.append(free[near][1:])
            leaders.append(np.full(len(members[-1]), free[0]))
            free = free[~near]
        return np.concatenate(leaders), np.concatenate(members), np.arange(m)
    near = _near(fp, fp)
    np.fill_diagonal(near, False)
    some = np.flatnonzero(near.any(1))
    free = np.ones(m, bool)
    for i in some.tolist():
        if free[i]:
            free[i] = False
            mine = np.flatnonzero(near[i] & free)
            free[mine] = False
            leaders.append(np.full(len(mine), i))
            members.append(mine)
    none = np.zeros(0, np.int64)
    p, q = np.concatenate([none, *leaders]), np.concatenate([none, *members])
    return p, q, some if 2 * len(p) < near.sum() else none


def met_leaders(it):
    """From the rows of ``dealt`` in order of buckets: pairs (a, b) of hashes; and rows (key, h, fp, m) of lines that may be near others too."""
    for pieces in runs(it, "bucket"):
        key, h, fp, first = _same_keys(*(np.concatenate([x.column(c).flatten().to_numpy() for x in pieces]) for c in ("keys", "h", "fp")))
        size = np.diff(np.r_[first, len(key)])
        two = first[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        a, b, more, m = [h[two]], [h[two + 1]], [], []
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            p, q, rest = stars(fp[at : at + n])
            a.append(h[at + p])
            b.append(h[at + q])
            more.append(at + rest)
            m.append(np.full(len(rest), n))
        a, b = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0).T
        none = np.zeros(0, np.int64)
        more, m = np.concatenate([none, *more]), np.concatenate([none, *m])
        fill, gap = np.zeros(len(more), np.int64), np.zeros(len(a), np.int64)
        columns = [np.r_[a, fill], np.r_[b, fill], np.r_[gap, key[more]], np.r_[gap, h[more]], np.r_[gap, fp[more].view(np.int64)], np.r_[gap, m]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["a", "b", "key", "h", "fp", "m"])


def candidates(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of rows (key, h, fp) that share the key and lie within ``RADIUS`` bits: what the operator's groups are made of."""
    key, h, fp, first = _same_keys(*(np.ascontiguousarray(x) for x in rows.T))
    found = [np.zeros((0, 2), np.int64)]
    for at, n in zip(first.tolist(), np.diff(np.r_[first, len(key)]).tolist()):
        p, q = np.nonzero(np.triu(_near(fp[at : at + n], fp[at : at + n]), 1))
        found.append(np.stack([h[at + p], h[at + q]], 1))
    out = np.unique(np.concatenate(found), axis=0)
    return out[:, 0], out[:, 1]


def candidate_rows(lines: DataFrame) -> DataFrame:
    """Pairs (a, b) of hashes of lines and their keys' leaders (m is 0), and rows (key, h, fp, m) of keys of m lines some of which may be near others too."""
    spark = lines.sparkSession
    keyed = lines.where("fp is not null").select("h", "fp", "keys")
    bits = max(6, (10 * keyed.count() // _BUCKET).bit_length())
    small_batches(spark, 1024)  # rows of about a hundred bytes
    parts = keyed.mapInArrow(lambda it: dealt(it, bits), "bucket long, keys array<long>, h array<long>, fp array<long>")
    parts = parts.repartition("bucket").sortWithinPartitions("bucket")
    found = materialize(parts.mapInArrow(met_leaders, "a long, b long, key long, h long, fp long, m long"), "line-candidates")
    small_batches(spark)
    return found


def met(it, nearest: bool):
    """From rows (key, i, j, e, fp, part, group) in order of squares: candidates (a, b) in different groups; of each other group the nearest only, if so."""
    for pieces in runs(it, "key", "i", "j"):
        e, fp, part, group, i, j = (np.concatenate([x.column(c).to_numpy() for x in pieces]) for c in ("e", "fp", "part", "group", "i", "j"))
        if (group == group[0]).all():
            continue
        fp, found = fp.view(U), []
        for at in range(0, len(e), 512):
            rows = slice(at, at + 512)
            bits = np.bitwise_count(fp[rows, None] ^ fp[None, :])
            ok = (bits <= RADIUS) & (group[rows, None] != group[None, :])
            if i[0] != j[0]:
                ok &= part[rows, None] != part[None, :]
            p, q = np.nonzero(ok)
            if nearest:
                order = np.lexsort((e[q], bits[p, q], group[q], p))
                p, q = p[order], q[order]
                start = np.r_[True, (p[1:] != p[:-1]) | (group[q[1:]] != group[q[:-1]])][: len(p)]
                keep = np.arange(len(p)) - np.maximum.accumulate(np.where(start, np.arange(len(p)), 0)) < _NEAREST
                p, q = p[keep], q[keep]
            found.append(np.sort(np.stack([e[at + p], e[q]], 1), axis=1))
        a, b = np.unique(np.concatenate(found), axis=0).T
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], names=["a", "b"])


def in_groups(rest: DataFrame, parts: DataFrame) -> DataFrame:
    """``rest`` with the group of each e: its component in ``parts`` (node, component), or itself."""
    return rest.join(parts.select(F.col("node").alias("e"), F.col("component").alias("group")), "e", "left").withColumn("group", F.coalesce("group", "e"))


def squares(rows: DataFrame, sides, *columns: str) -> DataFrame:
    """Rows (key, e and ``columns``) dealt into the squares (key, i, j) of as many parts of a key as ``sides``, in order; in each, part is the row's own."""
    tiles = rows.withColumn("part", F.pmod(F.xxhash64("e"), sides)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), sides - 1)))
    tiles = tiles.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "e", *columns)
    return tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def met_groups(rest: DataFrame, parts: DataFrame, nearest: bool) -> DataFrame:
    """(a, b): candidates among rows (key, e, fp, m) that are in different groups of ``parts`` (node, component), pair by pair: what ``met_links`` unites."""
    tiles = squares(in_groups(rest, parts), F.ceil(F.col("m") / TILE), "fp", "group")
    return tiles.mapInArrow(lambda it: met(it, nearest), "a long, b long").distinct()


def _shared(keys: pa.Array, key: int) -> np.ndarray:
    """For each list of keys, a row of bits for those below ``key`` that several lists have."""
    size = np.diff(keys.offsets.to_numpy())
    line, every = np.repeat(np.arange(len(size)), size), keys.flatten().to_numpy()
    line, every = line[every < key], every[every < key]
    _, at, counts = np.unique(every, return_inverse=True, return_counts=True)
    column = (np.cumsum(counts > 1) - 1)[at]
    bits = np.zeros((len(size), -(-int((counts > 1).sum()) // 64) * 64), bool)
    bits[line[counts[at] > 1], column[counts[at] > 1]] = True
    return np.packbits(bits, axis=1).view(U)


def square_links(it):
    """From rows of squares (key, i, j, part, e, fp, more, chars, group, keys, body): verified pairs (a, b) that unite the groups which all of a square's would."""
    for pieces in runs(it, "key", "i", "j"):
        table = pa.Table.from_batches(pieces).combine_chunks()
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        part, e, fp, more, chars, group = (table.column(c).to_numpy() for c in ("part", "e", "fp", "more", "chars", "group"))
        if (group == group[0]).all():
            continue
        body, earlier = table.column("body").to_pylist(), _shared(table.column("keys").chunk(0), key)
        fp, more, place, links = fp.view(U), more.view(U), np.arange(len(e)), []
        for at in range(0, len(e), 512):
            rows = slice(at, at + 512)
            bits = np.bitwise_count(fp[rows, None] ^ fp[None, :])
            ok = (bits <= RADIUS) & (group[rows, None] != group[None, :]) & (place[rows, None] < place[None, :])
            if i != j:
                ok &= part[rows, None] != part[None, :]
            p, q = np.nonzero(ok)
            bits, p = bits[p, q], p + at
            bits = bits + np.bitwise_count(more[p] ^ more[q])
            good = (bits <= 2 * RADIUS) & (abs(chars[p] - chars[q]) <= (1 - SIMILARITY) * np.maximum(chars[p], chars[q]) + 1e-9)
            order = np.flatnonzero(good)[np.argsort(bits[good], kind="stable")]
            for cut in range(0, len(order), 4096):
                x, y = p[order[cut : cut + 4096]], q[order[cut : cut + 4096]]
                todo = (group[x] != group[y]) & ~(earlier[x] & earlier[y]).any(1)
                for a, b in zip(x[todo].tolist(), y[todo].tolist()):
                    if group[a] != group[b] and similar(body[a], body[b]):
                        group = np.where(group == group[b], group[a], group)
                        links.append((e[a], e[b]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*links)], names=["a", "b"])


def met_links(rest: DataFrame, parts: DataFrame, body: DataFrame) -> DataFrame:
    """(a, b): verified pairs of rows (key, e, fp) that unite the groups of ``parts`` (node, component) which all would; ``body`` is that of ``line_texts``."""
    spark = rest.sparkSession
    sized = in_groups(rest.select("key", "e", "fp"), parts).join(body.select("e", "more", "chars"), "e")
    sized = materialize(sized, "line-rest")
    many = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("chars") / _CHARS)).alias("sides")
    several = sized.groupBy("key").agg(many, F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key", "sides")
    sized = materialize(sized.join(several, "key"), "line-rest")
    keys = sized.groupBy("e").agg(F.collect_list("key").alias("keys"))
    tiles = squares(sized.join(keys.join(body.select("e", "body"), "e"), "e"), F.col("sides"), "fp", "more", "chars", "group", "keys", "body")
    small_batches(spark, 1024)
    links = materialize(tiles.mapInArrow(square_links, "a long, b long"), "line-links")
    small_batches(spark)
    return links


def line_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(e, body, fp, more, chars) of the normalised lines in ``wanted`` (e, uid, line), from rows of (uid, text): text, 128-bit SimHash and code points.

    A bitmap of the places that are wanted goes to the executors, so that other lines aren't shuffled.
    """
    def marked(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array(_marks(batch.column("uid").to_numpy(), batch.column("line").to_numpy()).view(np.int64))], names=["mark"])

    marks = bitmap(wanted.select("uid", "line").mapInArrow(marked, "mark long"), "mark", wanted.count())
    shared = rows.sparkSession.sparkContext.broadcast(marks.tobytes())

    def batches(it):
        table = np.frombuffer(shared.value, np.uint8)
        for batch in it:
            data, uid = lower_bytes(batch.column("text")), batch.column("uid").to_numpy()
            for a, b in by_size(data):
                counts = np.array([x.count(b"\n") + 1 for x in data[a:b]])
                doc = np.repeat(np.arange(a, b), counts)
                line = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = np.flatnonzero(passes(table, _marks(uid[doc], line)))
                if not len(at):
                    continue
                parts = {i: data[i].split(b"\n") for i in set(doc[at].tolist())}
                buf = normalise([parts[i][j] for i, j in zip(doc[at].tolist(), line[at].tolist())])
                newline = np.flatnonzero(buf == 10)
                start, end = newline[:-1] + 1, newline[1:]
                real = np.flatnonzero(end > start)
                if not len(real):
                    continue
                at, start, end = at[real], start[real], end[real]
                h, _, n = line_words(buf, start, end)
                first = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
                whole = buf.tobytes()
                columns = [uid[doc[at]], line[at], prints_of(h, n, 1).view(np.int64), prints_of(h, n, 2).view(np.int64), first[end] - first[start]]
                columns = [*map(pa.array, columns), pa.array([whole[p:q] for p, q in zip(start.tolist(), end.tolist())], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "line", "fp", "more", "chars", "body"])

    found = rows.select("uid", "text").mapInArrow(batches, "uid long, line long, fp long, more long, chars long, body binary")
    return found.join(wanted, ["uid", "line"]).select("e", "body", "fp", "more", "chars")


def _marks(uid: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of each place."""
    return mix(uid.astype(U) * _ODD + line.astype(U))


def trim(a: str, b: str) -> tuple[str, str]:
    """Two strings without their common ends."""
    cut = _same_start(a, b)
    a, b = a[cut:], b[cut:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) >> 1
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    return a[: len(a) - low], b[: len(b) - low]


def _same_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) >> 1
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, by Myers' bit-parallel columns after common ends are cut; if it is over ``most``, some number over it.

    Every ``_LOOK`` columns or more, cells around the diagonal tell whether ``most`` can still be held.
    """
    a, b = trim(a, b)
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    most = len(b) if most is None else most
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    n, m = len(a), len(b)
    full = (1 << n) - 1
    look, step = max(_LOOK, m // 16), max(_STEP, most // 8)
    up, down = full, 0
    for cut in range(0, m, look):
        for eq in map(at.get, b[cut : cut + look], repeat(0)):
            diag = ((eq & up) + up ^ up) | eq | down
            right_up = (down | full & ~(diag | up)) << 1 | 1
            down, up = right_up & diag, ((up & diag) << 1 | ~(diag | right_up)) & full
        j = min(cut + look, m)
        if j < m:
            best = most + 1
            for i in range(max(0, j - most), min(n, j + most) + step, step):
                i = min(i, n)
                mask = (1 << i) - 1
                cell = j + (up & mask).bit_count() - (down & mask).bit_count()
                best = min(best, cell + abs((n - i) - (m - j)) - step)
            if best > most:
                return most + 1
    return m + up.bit_count() - (down & full).bit_count()


def distance_bound(x: list[str], y: list[str], most: int = -1) -> int:
    """At least the edit distance of two rows of words: words that each has once are laid side by side, what lies between is replaced.

    What lies between is compared exactly only until the sum is ``most`` or less.
    """
    once_x, once_y = Counter(x), Counter(y)
    places = {w: j for j, w in enumerate(y) if once_y[w] == 1}
    pairs = [(i, places[w]) for i, w in enumerate(x) if w in places and once_x[w] == 1]
    tails: list[int] = []
    back: list[tuple] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
        back[at : at + 1] = [(k, back[at - 1] if at else None)]
    chain, at = [], back[-1] if back else None
    while at:
        chain.append(pairs[at[0]])
        at = at[1]
    between, i, j = [], 0, 0
    for p, q in [*chain[::-1], (len(x), len(y))]:
        if (p > i or q > j) and (u := x[i:p]) != (v := y[j:q]):
            u, v = " ".join(u), " ".join(v)
            between.append((max(len(u), len(v)) + (not u or not v), u, v))
        i, j = p + 1, q + 1
    total = sum(n for n, _, _ in between)
    for n, u, v in between:
        if total <= most:
            break
        x, y = trim(u, v)
        total += (edit_distance(x, y) if len(x) * len(y) <= _SMALL else max(len(x), len(y))) + (not u or not v) - n
    return total


def similar(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length, over code points, is ``least`` or more."""
    x, y = a.decode(), b.decode()
    most = int((1 - least) * max(len(x), len(y), 1) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    x, y = trim(x, y)
    if max(len(x), len(y)) <= most:
        return True
    u, v = x.split(" "), y.split(" ")
    if len(u) == len(v) and sum(max(len(p), len(q)) for p, q in zip(u, v) if p != q) <= most:
        return True
    return max(len(x), len(y)) > _DIRECT and distance_bound(u, v, most) <= most or edit_distance(x, y, most) <= most


def alike(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Which pairs of normalised lines have 128-bit SimHashes within twice ``RADIUS`` bits, and half of each within ``RADIUS``."""
    sides = []
    for lines in (x, y):
        buf = np.frombuffer(b"\n" + b"\n".join(lines) + b"\n", np.uint8)
        sizes = np.array([len(z) for z in lines])
        start = np.cumsum(sizes + 1) - sizes
        h, _, n = line_words(buf, start, start + sizes)
        sides.append([prints_of(h, n, k) for k in (1, 2)])
    first, second = (np.bitwise_count(p ^ q) for p, q in zip(*sides))
    return (first <= RADIUS) & (first + second <= 2 * RADIUS)


def verified(pairs: DataFrame, body: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines in ``body`` (as of ``line_texts``) are alike and similar; only those alike and near in length go to Python."""

    def verify(it):
        for batch in it:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array([similar(p, q) for p, q in zip(x, y)], pa.bool_()))

    side = lambda e, x: body.select(F.col("e").alias(e), F.col("body").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("fp", "more", "chars")])
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    first, second = (F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in ("fp", "more"))
    most = (1 - SIMILARITY) * F.greatest("x_chars", "y_chars") + 1e-9
    both = both.where((first <= RADIUS) & (first + second <= 2 * RADIUS) & (F.abs(F.col("x_chars") - F.col("y_chars")) <= most))
    return materialize(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "line-links")


def joined_groups(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``parts`` (node, component) after the edges (a, b), between its nodes or others."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    over = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = connected_components(over.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    joined = materialize(joined, "line-joined")
    moved = parts.join(joined.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(moved.union(joined.join(parts, "node", "left_anti")), "line-parts")


def linked(lines: DataFrame, entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, component): the groups of entries (e, h, first) that all verified candidates link; ``rows`` (uid, text) hold their texts."""
    found = candidate_rows(lines)
    pairs, rest = found.where("m = 0").select("a", "b"), found.where("m > 0")
    hashes = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(rest.select("h")).distinct()
    wanted = materialize(entries.join(hashes, "h", "left_semi").select("e", "h", "first.uid", "first.line"), "line-wanted")
    body = materialize(line_texts(rows, wanted.select("e", "uid", "line")), "line-texts")
    name = lambda h, e: wanted.select(F.col("h").alias(h), F.col("e").alias(e))
    named = pairs.distinct().join(name("a", "x"), "a").join(name("b", "y"), "b")
    parts = materialize(connected_components(verified(named.select(F.col("x").alias("a"), F.col("y").alias("b")), body)), "line-parts")
    edges = met_links(rest.join(name("h", "e"), "h"), parts, body)
    return parts if edges.isEmpty() else joined_groups(parts, edges)


def removed_lines(rows: DataFrame) -> DataFrame:
    """(uid, lines): the numbers of the lines to remove from rows of (uid, id, text), id giving the order."""
    small_batches(rows.sparkSession)
    lines = materialize(line_rows(rows.select("id", "uid", "text")), "lines")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid", "line")).alias("first")
    entries = lines.groupBy("h", "g").agg(F.count("*").alias("n"), first)
    entries = materialize(entries.withColumn("e", F.monotonically_increasing_id()), "line-entries")
    groups = linked(lines, entries, rows).select(F.col("node").alias("e"), F.col("component").alias("group"))
    named = entries.join(groups, "e", "left").where("n > 1 or group is not null").withColumn("group", F.coalesce("group", "e"))
    kept = named.groupBy("group").agg(F.min("first").alias("keep"))
    where = materialize(named.select("h", "g", "group").join(kept, "group").select("h", "g", "keep.uid", "keep.line"), "line-kept")
    where = where.select("h", "g", F.col("uid").alias("keep_uid"), F.col("line").alias("keep_line"))
    gone = lines.select("h", "g", "uid", "line").join(where, ["h", "g"]).where("uid <> keep_uid or line <> keep_line")
    return gone.groupBy("uid").agg(F.collect_list("line").alias("lines"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the text of the lines that stay (joined by newlines), and n_lines and n_removed.

    The text of a row without lines to remove is untouched, null included.
    """
    small_batches(docs.sparkSession)
    names = list(docs.columns)
    at = {c: f"_l{i}" for i, c in enumerate(names)}
    safe = numbered(docs.select(*[F.col(c).alias(at[c]) for c in names]), "uid")
    rows = safe.select(F.col(at[doc_id]).cast("long").alias("id"), "uid", F.col(at[text]).cast("string").alias("text"))
    with passing(docs.sparkSession):
        gone = materialize(removed_lines(rows), "line-gone", last=True)
    joined = safe.join(gone.hint("merge"), "uid", "left").drop("uid")  # no broadcast of what grows with the input
    made = {"_llines": "long", "_lremoved": "long"}
    schema = joined.drop("lines").withColumns({k: F.lit(0).cast(v) for k, v in made.items()}).schema

    def batches(it):
        for batch in it:
            body, n, gone = [], [], []
            for whole, t, cut in zip(batch.column(at[text]).to_pylist(), texts(batch.column(at[text])), batch.column("lines").to_pylist()):
                parts = t.split("\n")
                drop = set(cut or ())
                body.append("\n".join(x for i, x in enumerate(parts) if i not in drop) if drop else whole)
                n.append(len(parts))
                gone.append(len(drop))
            columns = [pa.array(body, pa.string()) if c == at[text] else batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    out = joined.mapInArrow(batches, schema)
    kept = [F.col(at[c]).alias(c) for c in names if c not in ("n_lines", "n_removed")]
    return out.select(*kept, F.col("_llines").alias("n_lines"), F.col("_lremoved").alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of what stays of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
