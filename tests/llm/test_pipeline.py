import hashlib
import os
import sys

import sentencepiece

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline as C
import test_decontaminate
import test_lines
import test_simhash
from gridloom.llm import pieces, quality

SF = "/root/testdata/sf0.001"


def test_against_a_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").orderBy("doc_id").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = []
    for i, t, s in docs:
        n, _, _, _, repeated = quality.measure((t or "").encode())
        if n >= 10 and 100 * repeated <= 20 * n:
            good.append((i, t))
    out = [(i, t) for i, _, _, t in test_lines.brute(good)]
    first = test_simhash.brute_first(out)
    out = [x for x in out if x[0] in first]
    bad = {i for i, _ in test_decontaminate.brute(out, items)}
    out = [x for x in out if x[0] not in bad]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = {}
    for i, t in out:
        ids = sp.encode(t or "") + [2]
        want[i] = (ids, hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in C.run(spark, SF).collect()}
    assert got == want


def test_stages_stand_odd_rows(spark):
    """Nulls, repeated rows and ids, very long texts, and columns of the operators' own names."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", "s", 9, 1, "a"), (1, words, "en", "s", 9, 1, "a"), (2, None, None, None, None, None, None), (None, words + " more", "en", None, 5, 2, "b")]
    rows += [(3, "x" * 300_000, "en", "s", 1, 3, "c"), (4, " ".join(f"v{i}" for i in range(60_000)), "en", "s", 1, 4, None), (5, "", "en", "s", 0, 5, "d")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept long, key string")
    docs = odd
    for name, stage in C.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, SF), "odd")
        assert docs.dtypes == odd.dtypes
    kept = sorted((r.doc_id, r.text, r.kept, r.key) for r in docs.collect())
    assert kept == [(1, "", 1, "a"), (1, words, 1, "a"), (4, rows[5][1], 4, None)]  # the repeated row's line went, which left the first empty text
    assert C.STAGES[-1][1](spark, docs, SF).count() == 3


def test_stages_keep_columns_and_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, empty, SF)
        assert out.count() == 0
        assert k == len(C.STAGES) - 1 or out.dtypes == docs.dtypes
