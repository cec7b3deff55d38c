import zlib

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import tokens as K
from gridloom.llm.common import fresh_path

PATH = K.tokenizer_path()
TK = Tokenizer.from_file(PATH)
ENC = K.encoder(PATH)
BITS = ["it's", "x'sy", "a.b", "1,2", "é.", "a\nb", ".\nT", "\0", "'", "$'s", " ", "  ", "\n", "a", "the", "'s", "\t ", " \n ", " ", "　", "\x1c", "\x85", "é", "😀", "<|endoftext|>", "1", "!", "​"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(BITS), max_size=25).map("".join)))
def test_like_the_library(text):
    ids, counts = ENC.encode([text.encode(), b"", text.encode() + b" end"], 0)
    want = [TK.encode(x, add_special_tokens=False).ids + [0] for x in (text, "", text + " end")]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_another_kind_of_tokenizer():
    """One that can't be cut at spaces encodes whole texts."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, plain = K.Encoder(path), Tokenizer.from_file(path)
    assert not enc.cuts and ENC.cuts
    whole = ["The quick  brown fox", "", "É a\n b <|endoftext|> c"]
    ids, counts = enc.encode([x.encode() for x in whole], 5)
    want = [plain.encode(x, add_special_tokens=False).ids + [5] for x in whole]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(K, "mix", lambda x: x & np.uint64(3))
    enc = K.Encoder(PATH)
    text = "some words that share few hashes as they are of these lengths"
    assert enc.encode([text.encode()], 0)[0].tolist() == TK.encode(text, add_special_tokens=False).ids + [0]


def test_table_starts_afresh(monkeypatch):
    monkeypatch.setattr(K, "CACHE", 30)
    enc = K.Encoder(PATH)
    for i in range(9):
        text = " ".join(f"w{i}x{j}" for j in range(20))
        assert enc.encode([text.encode()], 0)[0].tolist() == TK.encode(text, add_special_tokens=False).ids + [0]


def text_order(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h, text.encode()


def brute(rows):
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_order(r[1] or ""))):
        ids = np.array(TK.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, K.op2_token_files(spark, sf).collect()), key=lambda r: r[1])
    assert got == brute([tuple(r) for r in docs])


def test_odd_rows(spark, odd_docs):
    folder = fresh_path(spark, "tokens")
    got = K.read_tokens(K.write_tokens(odd_docs.repartition(3), folder, PATH), folder, "<u2").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    folder = fresh_path(spark, "tokens")
    assert K.read_tokens(K.write_tokens(odd_docs.limit(0), folder, PATH), folder, "<u2").count() == 0
