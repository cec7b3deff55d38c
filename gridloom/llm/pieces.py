"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's texts fall into words, which no merge can cross, and each distinct word is encoded once. All of
them, of any length, go through the merge rounds together: flat arrays of symbols and of pair ranks, the least
rank of each word by a segmented minimum, the leftmost merges of that rank in every word at once, and compaction,
until no pair is left. A word takes one round for each rank that it merges at, or a little more, not one for each
merge; only where merges of a very long word follow from each other (``WORK``) a heap ends what rounds began.

The model is a BPE model with byte fallback, an identity normaliser, a dummy prefix and kept spaces, as
loading checks. Defined results: a null or empty text has the end id alone and decodes to an empty text;
any other text is encoded whole; repeated rows come out as often; an empty table gives an empty result;
other columns are passed on, and helper columns start with ``_p``.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, small_batches

SPACE = "▁"
#: Symbols times rounds that a word may take; one that has more symbols left after so many is finished by a heap.
WORK = 1 << 22
#: Words whose encodings a worker keeps; beyond, it starts afresh.
CACHE = 250_000
_NONE = np.int64(2**62)
_loaded: dict[str, "PieceModel"] = {}


def load(path: str) -> "PieceModel":
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


class PieceModel:
    """Tables of a model file: pieces, ranks of pairs, and bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)) or sp.encode("ﬁ  a", out_type=str)[-2:] != [SPACE, SPACE + "a"][-2:]:
            raise ValueError("a BPE model with an identity normaliser and without unused pieces is expected")
        self.end = sp.eos_id()
        self.size = n
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece goes over a word's start")
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_ids = byte_ids
        #: Symbols: ids of pieces; then characters of pieces that are none themselves; others by code point.
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.of_char = np.arange(0x110000, dtype=np.int64) + 2**24
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        keys, merged, ranks = [], [], []
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
                    ranks.append(order[sp.get_score(i)])
        at = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged, self.ranks = (np.array(x, np.int64)[at] for x in (keys, merged, ranks))
        self.pair = {k: (r, m) for k, r, m in zip(keys, ranks, merged)}
        self.in_pieces = {c for p in normal if len(p) > 1 for c in p}
        self.breaks = "\n" not in self.in_pieces
        self.pattern = re.compile(rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if self.breaks else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        fallback = {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.bytes_of = [fallback.get(i, b" \xe2\x81\x87 " if sp.is_unknown(i) else b"" if special[i] else p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)]
        #: Ids whose text keeps a space at its start.
        self.bytes_of_byte = frozenset([*byte_ids, sp.unk_id()])
        self.sp = sp
        self.cache: dict[str, tuple[bytes, int, bytes]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged symbol of each pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """The symbols that are left of each (non-empty) word when no pair can be merged.

        A round merges the pairs of each word's least rank, from the left and without overlap, up to the first whose
        symbol makes a pair of that rank or less with a neighbour: one after the other, these would come next too.
        """
        lengths = np.array([len(w) for w in words])
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        out: list = [None] * len(words)
        word = np.repeat(np.arange(len(words)), lengths)
        if not len(sym):
            return out
        rank, new = self._pair_row(sym, word)
        rounds = 0
        while len(sym):
            rounds += 1
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(sym)])
            over = best == _NONE
            heavy = ~over & (sizes * rounds > WORK)
            over |= heavy
            if over.any():
                for i in np.flatnonzero(over):
                    left = sym[first[i] : first[i] + sizes[i]]
                    out[word[first[i]]] = self._merge_long(left) if heavy[i] else left
                stay = np.repeat(~over, sizes)
                sym, word, rank, new = sym[stay], word[stay], rank[stay], new[stay]
                best, sizes = best[~over], sizes[~over]
            if not len(sym):
                break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            if len(at) > len(best):
                n = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], n, 0))
                at = at[(n - run) % 2 == 0]
            least, made, of = rank[at], new[at], word[at]
            left = np.maximum(at - 1, 0)
            before = np.where(np.r_[-2, at[:-1]] == at - 2, np.r_[0, made[:-1]], sym[left])
            left_rank, left_new = self._ranks(before, made)
            left_rank = np.where((at > 0) & (word[left] == of), left_rank, _NONE)
            right = np.minimum(at + 2, len(sym) - 1)
            right_rank, right_new = self._ranks(made, sym[right])
            right_rank = np.where((at + 2 < len(sym)) & (word[right] == of), right_rank, _NONE)
            if len(at) > len(best):
                ends = np.cumsum((left_rank <= least) | (right_rank <= least))
                earlier = np.r_[0, ends[:-1]]
                begins = np.maximum.accumulate(np.where(np.r_[True, of[1:] != of[:-1]], earlier, 0))
                keep = earlier == begins
                at, made, left_rank, left_new, right_rank, right_new = (x[keep] for x in (at, made, left_rank, left_new, right_rank, right_new))
            sym[at], rank[at], new[at] = made, right_rank, right_new
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            to = (np.cumsum(stay) - 1)[at]
            sym, word, rank, new = sym[stay], word[stay], rank[stay], new[stay]
            some = to > 0  # after the right sides: of two symbols made side by side, the later one tells their pair
            rank[to[some] - 1] = left_rank[some]
            new[to[some] - 1] = left_new[some]
        return out

    def _pair_row(self, sym, word):
        rank, new = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            r, new[:-1] = self._ranks(sym[:-1], sym[1:])
            rank[:-1] = np.where(word[:-1] == word[1:], r, _NONE)
        return rank, new

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges, one after the other: a heap of pairs over a linked list."""
        sym = symbols.tolist()
        n = len(sym)
        nxt, prev = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i):
            j = nxt[i]
            if j >= 0 and (found := self.pair.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], nxt[i] = m, -1, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return np.array([x for x in sym if x >= 0], np.int64)

    def ids_of(self, symbols: np.ndarray, word: str) -> list[int]:
        """Ids of a word's symbols; a symbol that is no piece becomes its UTF-8 bytes."""
        ids = symbols.tolist()
        if max(ids) < self.size:
            return ids
        out, at = [], 0
        for s in ids:
            if s < self.size:
                out.append(s)
                at += self.lengths[s]
            else:
                out += [self.byte_ids[b] for b in word[at].encode("utf-8", "surrogatepass")]
                at += 1
        return out

    @property
    def lengths(self) -> list[int]:
        if not hasattr(self, "_lengths"):
            self._lengths = [len(self.sp.id_to_piece(i)) for i in range(self.size)]
        return self._lengths

    def words(self, text: str) -> list[str]:
        """The words of a text, with the dummy prefix; an empty text has none."""
        return self.pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: set[str]) -> None:
        """Encode the words that the cache lacks: decimal ids, their number and ids as 32-bit integers."""
        if len(self.cache) + len(words) > CACHE:
            self.cache.clear()
        new = [w for w in words if w not in self.cache]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for w, symbols in zip(part, self.merge_words(part)):
                ids = self.ids_of(symbols, w)
                self.cache[w] = (" ".join(map(str, ids)).encode(), len(ids), np.array(ids, np.int32).tobytes())

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        words = self.words(text)
        self.learn(set(words))
        return [int(x) for w in words for x in self.cache[w][0].split()] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces without the dummy prefix; bytes that are no UTF-8 become U+FFFD each."""
        raw = b"".join([self.bytes_of[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self.sp.decode(ids)
        first = next((i for i in ids if self.bytes_of[i]), None)
        return text[1:] if first is not None and first not in self.bytes_of_byte and text.startswith(" ") else text


    def decode_rows(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of rows of ids of encoded texts that lie one after another: a lookup of each id's bytes."""
        if not hasattr(self, "_spelt"):
            sizes = np.array([len(x) for x in self.bytes_of])
            self._spelt = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array([i not in self.bytes_of_byte for i in range(self.size)])
        table, first, sizes, plain = self._spelt
        size = sizes[ids]
        upto = np.cumsum(size)
        body = table[np.repeat(first[ids] - (upto - size), size) + np.arange(size.sum())].tobytes()
        ends = np.r_[0, upto][np.cumsum(counts)].tolist()
        heads = np.cumsum(counts) - counts
        begins = [0, *ends[:-1]]
        return [body[a + (b > a and body[a] == 32 and bool(plain[ids[h]])) : b] for a, b, h in zip(begins, ends, heads.tolist())]


def encode_texts(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Add _pids (array<int>) to the rows, the end id last."""
    small_batches(docs.sparkSession)
    return _mapped(docs, text, {"_pids": "array<int>"}, lambda m, t: (m.encode(t),), model)


def decode_ids(rows: DataFrame, model: str, ids: str = "_pids") -> DataFrame:
    """Add _ptext, the decoded ids; null ids decode to an empty text."""
    small_batches(rows.sparkSession)
    schema = rows.withColumn("_ptext", F.lit("")).schema

    def batches(it):
        m = load(model)
        for batch in it:
            out = [m.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "_ptext"])

    return rows.mapInArrow(batches, schema)


def _mapped(docs: DataFrame, text: str, columns: dict[str, str], each, model: str) -> DataFrame:
    schema = docs.withColumns({k: F.lit(None).cast(v) for k, v in columns.items()}).schema

    def batches(it):
        from pyspark.sql.pandas.types import to_arrow_type

        m = load(model)
        kinds = [to_arrow_type(schema[c].dataType) for c in columns]
        for batch in it:
            found = [each(m, x or "") for x in batch.column(text).to_pylist()]
            new = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *columns])

    return docs.mapInArrow(batches, schema)


def digests(docs: DataFrame, model: str, text: str = "text", ids_column: str | None = None) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each row, instead of its text; and its ids if a column is named. No shuffle.

    Ids are joined from the words' stored parts, so no Python list of all ids is built; the text is decoded from the ids.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in (text, ids_column, "n_tokens", "ids_sha256", "decoded_sha256")]
    schema = docs.select(*names, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"), *([F.lit(None).cast("array<int>").alias(ids_column)] if ids_column else [])).schema

    def batches(it):
        m = load(model)
        end, last = str(m.end).encode(), np.array([m.end], np.int32).tobytes()
        for batch in it:
            whole = [m.words(t.decode()) for t in byte_texts(batch.column(text))]
            m.learn({w for ws in whole for w in ws})
            n, ids, raw = [], [], []
            for words in whole:
                parts = [m.cache[w] for w in words]
                n.append(sum([p[1] for p in parts]) + 1)
                ids.append(hashlib.sha256(b" ".join([p[0] for p in parts] + [end])).hexdigest())
                raw += [p[2] for p in parts]
                raw.append(last)
            flat = np.frombuffer(b"".join(raw), np.int32)
            decoded = [hashlib.sha256(x).hexdigest() for x in m.decode_rows(flat, np.array(n, np.int64))]
            columns = [*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            if ids_column:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(batches, schema)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, model_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
