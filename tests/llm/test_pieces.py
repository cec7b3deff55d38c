import hashlib

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import pieces as P

PATH = P.model_path()
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = P.load(PATH)
WORDS = ["the", " and", "  ", "\n", "\n\n", "▁", "</s>", "<0x0A>", "über", "😀", "\u0000", "int main() {", " " * 17, "aaaa", "ñ", "́", "日本語", "\t"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.one_of(st.sampled_from(WORDS), st.text(max_size=5)), max_size=30).map("".join)))
def test_like_the_library(text):
    ids = MODEL.encode(text)
    assert ids == SP.encode(text) + [SP.eos_id()]
    assert MODEL.decode(ids) == SP.decode(ids)
    rows = [ids, MODEL.encode(""), MODEL.encode("b" + text)]
    flat = np.array([x for r in rows for x in r])
    assert [x.decode() for x in MODEL.decode_rows(flat, np.array([len(r) for r in rows]))] == [SP.decode(r) for r in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=12))
def test_decode_any_ids(ids):
    assert MODEL.decode(ids) == SP.decode(ids)


def test_long_words():
    for text in ("x" * 3000, " " * 700, "ab" * 400 + "日" * 300 + "\u0001" * 300, "wordandword" * 100):
        assert MODEL.encode(text) == SP.encode(text) + [2]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").toPandas()
    got = P.op8_sentencepiece(spark, sf).toPandas().sort_values("doc_id")
    want = [SP.encode(t or "") + [2] for t in docs.text]
    assert got.n_tokens.tolist() == [len(x) for x in want]
    assert got.ids_sha256.tolist() == [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in want]
    assert got.decoded_sha256.tolist() == [hashlib.sha256(SP.decode(x).encode()).hexdigest() for x in want]


def test_odd_rows(spark, odd_docs):
    rows = P.decode_ids(P.encode_texts(odd_docs, PATH), PATH).collect()
    assert len(rows) == odd_docs.count()
    assert all(r._ptext == (r.text or "") and r._pids == SP.encode(r.text or "") + [2] for r in rows)
    assert P.digests(odd_docs, PATH).count() == len(rows)
    assert P.digests(odd_docs.limit(0), PATH).count() == 0
