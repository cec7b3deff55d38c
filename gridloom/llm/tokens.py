"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by id. Each task writes part-N.bin, the little-endian unsigned ids
of its documents one after another (16 bits where the vocabulary allows, else 32), and part-N.len, a record
of 64-bit integers for each document: whether its id is null, the id, and its number of ids. A prefix sum over
the parts' totals gives each part's base; a second job writes part-N.off (the 64-bit offset of each
document's first id in the whole sequence, and the end), memory-maps the files and reads them back.

Files are written under a name of their own and renamed, so a retried or doubled task leaves one whole copy.
Only one row a part (its number and totals) goes through the driver.

Defined results: a null text is empty, so it has the end id alone; null doc_ids come first; rows that share a
doc_id are in the order of a hash of their texts, then of the texts, so that one id of very many rows is split
over tasks; an empty table gives an empty result; other columns aren't used.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, by_size, byte_texts, fresh_path, get_bytes, mix, open_store, prefix_hashes, put_file, small_batches, span_hashes

#: Pieces of text whose ids a worker keeps; beyond, it starts afresh.
CACHE = 1_500_000


_loaded: dict[str, "Encoder"] = {}


def _solid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that are, or begin, or lie so far before the end of, a character that can't be white space."""
    b = np.arange(256)
    ascii_ = (b > 32) & (b < 127)
    two, three, four = (b >= 0xC3) & (b <= 0xDF), (b == 0xE0) | ((b >= 0xE4) & (b <= 0xEF)), b >= 0xF0
    return ascii_, ascii_ | two | three | four, two, three, four


_ASCII, _BEGINS, _TWO, _THREE, _FOUR = _solid()


_WORD = np.array([chr(x).isalnum() for x in range(128)] + [False] * 128)
_MARK = _ASCII & ~_WORD


def piece_starts(buf: np.ndarray) -> np.ndarray:
    """Where a new token always begins, in UTF-8 with three bytes or more before and one after all texts.

    That is at a single space, and before and after a single line feed, between two characters that are no white space,
    and at a mark after a letter or digit (all ASCII). Some characters are taken for white space that are none, which
    leaves longer pieces only.
    """
    at = np.flatnonzero((buf[3:-1] == 32) | (buf[3:-1] == 10)) + 3
    before = _ASCII[buf[at - 1]] | ((buf[at - 1] & 0xC0 == 0x80) & (_TWO[buf[at - 2]] | _THREE[buf[at - 3]] & (buf[at - 2] & 0xC0 == 0x80)))
    at = at[_BEGINS[buf[at + 1]] & before]
    marks = np.flatnonzero(_MARK[buf[1:]] & _WORD[buf[:-1]]) + 1
    return np.concatenate([at, at[buf[at] == 10] + 1, marks])


class _Slots:
    """Numbers by 64-bit hash: open addressing, at most half full."""

    def __init__(self):
        self.n, self.keys, self.values = 0, np.zeros(1 << 12, U), np.zeros(1 << 12, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where there is none."""
        out, todo, step = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        last = U(len(self.keys) - 1)
        while len(todo):
            at = ((hashes[todo] + U(step)) & last).astype(np.int64)
            held = self.keys[at]
            hit = held == hashes[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo, step = todo[~hit & (held != 0)], step + 1
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Add distinct hashes that aren't held."""
        self.n += len(hashes)
        if 2 * self.n > len(self.keys):
            old = self.keys != 0
            hashes, values = np.r_[self.keys[old], hashes], np.r_[self.values[old], values]
            size = 1 << (4 * self.n).bit_length()
            self.keys, self.values = np.zeros(size, U), np.zeros(size, np.int32)
        todo, step, last = np.arange(len(hashes)), 0, U(len(self.keys) - 1)
        while len(todo):
            at = ((hashes[todo] + U(step)) & last).astype(np.int64)
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[todo[free]]
            mine = free & (self.keys[at] == hashes[todo])
            self.values[at[mine]] = values[todo[mine]]
            todo, step = todo[~mine], step + 1


class _Rows:
    """An array that grows by doubling."""

    def __init__(self, dtype, width: int | None = None):
        self.n, self._all = 0, np.zeros((1024, width) if width else 1024, dtype)

    @property
    def rows(self) -> np.ndarray:
        return self._all[: self.n]

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self._all):
            self._all = np.concatenate([self.rows, np.zeros_like(self._all, shape=(self.n + 2 * len(more), *self._all.shape[1:]))])
        self._all[self.n : self.n + len(more)] = more
        self.n += len(more)


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    In a byte-level tokenizer with the common pattern, texts are cut where ``piece_starts`` tells. Pieces are found in a table by a hash, their bytes are compared
    with the table's, and the library encodes those that aren't in it. With a tokenizer of another kind
    (``cuts`` tells), a piece is a whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        made = json.loads(self.tokenizer.to_str())
        kind, added = made.get("pre_tokenizer") or {}, self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in added.values()]
        apart = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) and " " not in t.content for t in added.values())
        self.cuts = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not made.get("normalizer") and apart
        plain = [(i, t.content.encode()) for i, t in added.items() if t.special]
        self.mark = plain[0] if plain and self.cuts else None
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots()
        self.bodies = _Rows(np.uint8)
        self.ids = _Rows(self.dtype)
        self.place = _Rows(np.int64, 4)  # first byte, bytes, first id, ids of each piece

    def _library(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces, each encoded by itself, and their numbers. Many go in one call: a special token between two keeps them apart."""
        ids, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            found = np.array(self.tokenizer.encode_batch_fast([self.mark[1].join(part).decode()], add_special_tokens=False)[0].ids, self.dtype)
            marks = found == self.mark[0]
            ends = np.flatnonzero(marks)
            if len(ends) != len(part) - 1:
                raise ValueError("pieces aren't kept apart")
            counts.append(np.diff(np.r_[-1, ends, len(found)]) - 1)
            ids.append(found[~marks])
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Add pieces to the table; returns their slots."""
        held = [self.mark is None or any(t in x for t in self.added) for x in pieces]
        order = sorted(range(len(pieces)), key=held.__getitem__) if any(held) else range(len(pieces))
        apart = len(pieces) - sum(held)
        pieces = [pieces[i] for i in order]
        ids, counts = self._library(pieces[:apart])
        alone = [np.array(self.tokenizer.encode(x.decode(), add_special_tokens=False).ids, self.dtype) for x in pieces[apart:]]
        ids, counts = np.concatenate([ids, *alone]), np.r_[counts, np.array([len(x) for x in alone], np.int64)]
        sizes = np.array([len(x) for x in pieces])
        first = self.place.n
        place = [self.bodies.n + np.cumsum(sizes) - sizes, sizes, self.ids.n + np.cumsum(counts) - counts, counts]
        self.place.add(np.stack(place, 1))
        self.ids.add(ids)
        self.bodies.add(np.frombuffer(b"".join(pieces), np.uint8))
        slots = np.empty(len(pieces), np.int64)
        slots[np.fromiter(order, np.int64, len(pieces))] = first + np.arange(len(pieces))
        self.slots.add(hashes, slots)
        return slots

    def encode(self, whole: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8) in a row, each with the end id, and the number of ids of each."""
        buf = np.frombuffer(b"\0\0\0" + b"\0".join(whole) + b"\0\0", np.uint8)
        sizes = np.array([len(x) for x in whole], np.int64)
        first = 3 + np.cumsum(sizes + 1) - sizes - 1
        begins = np.zeros(len(buf), bool)
        raw = buf.tobytes()
        if self.cuts:
            begins[piece_starts(buf)] = True
            for t in self.added:
                at = raw.find(t)
                while at >= 0:
                    begins[at + 1 : at + len(t)] = False
                    at = raw.find(t, at + 1)
        begins[first[sizes > 0]] = True
        start = np.flatnonzero(begins)
        if not len(start):
            return np.full(len(whole), end, self.dtype), np.ones(len(whole), np.int64)
        text = np.searchsorted(first, start, "right") - 1
        stop = np.minimum(np.r_[start[1:], len(buf)], (first + sizes)[text])
        size = stop - start
        hashes = np.maximum(mix(span_hashes(prefix_hashes(buf), start, stop) + size.astype(U)), U(1))
        if self.slots.n > CACHE:
            self._clear()
        slot = self.slots.find(hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            order = np.argsort(hashes[new], kind="stable")
            sorted_ = hashes[new][order]
            once = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
            chosen = new[order[once]]
            found = self._learn(sorted_[once], [raw[i:j] for i, j in zip(start[chosen].tolist(), stop[chosen].tolist())])
            slot[new[order]] = np.repeat(found, np.diff(np.r_[once, len(order)]))
        place, table = self.place.rows, self.ids.rows
        if (place[slot, 1] != size).any() or not self._same(buf, start, size, place[slot, 0]):
            return self._plainly(whole, end)
        # an end id after the pieces of each text
        every = np.zeros(len(slot) + len(whole), np.int64)
        every[np.arange(len(slot)) + text] = place[slot, 3]
        closing = np.searchsorted(text, np.arange(len(whole)), "right") + np.arange(len(whole))
        every[closing] = 1
        begin = np.zeros(len(every), np.int64)
        begin[np.arange(len(slot)) + text] = place[slot, 2]
        upto = np.cumsum(every)
        ids = table[np.minimum(np.repeat(begin - (upto - every), every) + np.arange(upto[-1]), len(table) - 1)]
        ids[upto[closing] - 1] = end
        return ids, np.diff(np.r_[0, upto[closing]])

    def _same(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, known: np.ndarray) -> bool:
        """Whether all pieces have the bytes that the table has for them."""
        before, spread = np.cumsum(size) - size, np.arange(size.sum())
        return bool((buf[np.repeat(start - before, size) + spread] == self.bodies.rows[np.repeat(known - before, size) + spread]).all())

    def _plainly(self, whole: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Two pieces share a hash: the library encodes the texts as they are."""
        found = [np.array([*e.ids, end], self.dtype) for e in self.tokenizer.encode_batch_fast([x.decode() for x in whole], add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found])


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the parts and return (part, docs, tokens, base) for each, base being the ids of all parts before it."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", F.coalesce("text", F.lit(""))).drop("h")
    _make_folder(folder)

    def batches(it):
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        store, at = open_store(folder)
        lengths: list[np.ndarray] = []

        def ids():
            for batch in it:
                data, column = byte_texts(batch.column("text")), batch.column("id")
                record = np.zeros((len(data), 3), "<i8")
                record[:, 0] = np.asarray(column.is_null())
                record[:, 1] = column.fill_null(0).to_numpy(zero_copy_only=False)
                for a, b in by_size(data):
                    found, record[a:b, 2] = enc.encode(data[a:b], end)
                    yield found.tobytes()
                lengths.append(record)

        put_file(store, f"{at}/part-{part:06d}.bin", ids())
        record = np.concatenate(lengths) if lengths else np.zeros((0, 3), "<i8")
        put_file(store, f"{at}/part-{part:06d}.len", [record.tobytes()])
        row = [[part], [len(record)], [int(record[:, 2].sum())]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in row], names=["part", "docs", "tokens"])

    parts = sorted(tuple(x) for x in rows.mapInArrow(batches, "part long, docs long, tokens long").collect())
    bases = np.cumsum([0, *[x[2] for x in parts]]).tolist()
    made = [(*x, b) for x, b in zip(parts, bases) if x[1]]
    return spark.createDataFrame(made, "part long, docs long, tokens long, base long")


def _make_folder(folder: str) -> None:
    store, at = open_store(folder)
    store.create_dir(at, recursive=True)


def read_tokens(parts: DataFrame, folder: str, dtype: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files; writes the offset files first."""
    spark = parts.sparkSession
    kind = np.dtype(dtype)

    def batches(it):
        store, at = open_store(folder)
        for batch in it:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                name = f"{at}/part-{part:06d}"
                record = get_bytes(store, f"{name}.len").view("<i8").reshape(-1, 3)
                put_file(store, f"{name}.off", [(base + np.concatenate([[0], np.cumsum(record[:, 2])])).astype("<i8").tobytes()])
                offsets, ids = get_bytes(store, f"{name}.off").view("<i8"), get_bytes(store, f"{name}.bin").view(kind)
                for i in range(0, len(record), 4096):
                    to = min(len(record), i + 4096)
                    crc = [zlib.crc32(ids[a - base : b - base].astype("<u4")) for a, b in zip(offsets[i:to], offsets[i + 1 : to + 1])]
                    doc = pa.array(np.array(record[i:to, 1]), mask=record[i:to, 0] == 1)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(np.array(offsets[i:to])), pa.array(np.array(record[i:to, 2])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, parts.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return parts.repartition(min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(batches, schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = fresh_path(spark, "tokens")
    parts = write_tokens(docs, folder, tokenizer_path(), end=0)
    return read_tokens(parts, folder, "<u2")
