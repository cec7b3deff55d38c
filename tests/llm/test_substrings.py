import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import substrings as S


def brute(texts):
    seen = defaultdict(int)
    for t in texts:
        for s in range(len(t) - S.LENGTH + 1):
            seen[t[s : s + S.LENGTH]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - S.LENGTH + 1):
            if seen[t[s : s + S.LENGTH]] > 1:
                gone[s : s + S.LENGTH] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        out.append((len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def result(df):
    return [tuple(r)[1:] for r in sorted(df.collect())]


def test_sort_matches_plain_sort():
    rng = np.random.default_rng(5)
    for m in (1, 2, 3, 17, 64):
        bodies = [bytes(rng.choice([97, 98], rng.integers(1, 40)).astype(np.uint8)) for _ in range(m)]
        sizes = np.array([len(b) for b in bodies])
        base = np.cumsum(sizes) - sizes
        s = S.Suffixes(np.frombuffer(b"".join(bodies), np.uint8), base, base + sizes)
        order = S.sort_groups(s, np.zeros(m, int), np.full(m, m))
        assert order.tolist() == sorted(range(m), key=lambda i: (bodies[i], i))


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_windows_have_one_run_each(data):
    texts = [bytes(np.random.default_rng(data.draw(st.integers(0, 99))).choice([97, 98, 99], data.draw(st.integers(0, 900))).astype(np.uint8)) for _ in range(3)]
    h, c, doc, lo, at, n = S.runs(texts)
    windows = sorted((d, w) for d, a, k in zip(doc, lo, n) for w in range(a, a + k))
    assert windows == [(d, w) for d, t in enumerate(texts) for w in range(len(t) - S.LENGTH + 1)]


def planted(seed=1, n=60):
    rng = np.random.default_rng(seed)
    passages = [bytes(rng.integers(97, 107, int(rng.integers(150, 500))).astype(np.uint8)) for _ in range(5)]
    texts = []
    for _ in range(n):
        t = b""
        for _ in range(int(rng.integers(0, 4))):
            t += bytes(rng.integers(97, 107, int(rng.integers(0, 150))).astype(np.uint8))
            p = bytearray(passages[int(rng.integers(5))])
            if rng.random() < 0.4:
                p[int(rng.integers(len(p)))] = 122
            t += bytes(p)
        texts.append(t)
    return texts + [texts[3], b"ab" * 400, b"x" * 1000, b"abc" * 66 + b"ab", b"abc" * 67, b""]


@pytest.mark.parametrize("most", [256, 2])
def test_planted(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST", most)
    texts = planted()
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5, "doc_id")
    assert result(S.strip_repeats(docs, digest=True)) == brute(texts)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert result(S.op4_substring_dedup(spark, sf)) == brute([(r.text or "").encode() for r in docs])


def test_odd_rows(spark, odd_docs):
    got = S.strip_repeats(odd_docs).collect()
    want = brute([(r.text or "").encode() for r in odd_docs.collect()])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == sorted(want)
    assert S.strip_repeats(odd_docs.limit(0)).count() == 0
