import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import simhash as S


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=2):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    best = {}
    for i, x in enumerate(ids):
        if x is not None:
            best[root(i)] = min(best.get(root(i), x), x)
    return [best.get(root(i)) for i in range(len(prints))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \n\t\x1f\xa0é😀", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) % 2**64 == brute_print(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(map(str, range(500)))
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "_CHUNK", 7)
    assert S.fingerprint(text.encode()) == whole


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").toPandas()
    got = S.op3_simhash(spark, sf).toPandas().sort_values("doc_id")
    prints = [brute_print(t) for t in docs.text]
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == brute_components(prints, docs.doc_id.tolist())


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_links_sparse_and_dense(spark, most):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    prints = {b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(40)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most=most)
    found = {x.node: x.component for x in S.connected_components(edges).collect()}
    want = brute_components([x % 2**64 for x in signed], signed)
    assert [found.get(x, x) for x in signed] == want


def test_odd_rows(spark, odd_docs):
    got = S.near_duplicates(odd_docs)
    assert got.count() == odd_docs.count()
    assert got.where("fingerprint = repeat('0', 16)").select("component_id").distinct().collect()[0][0] == 0
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.where("doc_id = 3").count() == 1 and kept.where(F.col("text").isNull() | (F.trim("text") == "")).count() == 1
    empty = odd_docs.limit(0)
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0


def word_sets(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_first(docs):
    """The ids that stay when texts with a Jaccard similarity of 0.8 or more are linked; no fingerprints."""
    sets = [word_sets(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    best = {}
    for i, (x, _) in enumerate(docs):
        best[root(i)] = min(best.get(root(i), x), x)
    return set(best.values())


@pytest.mark.parametrize("most", [1, 64])
def test_keep_one_against_plain_jaccard(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S.shingle_links, "__defaults__", (most,))
    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(2000)]
    docs = []
    for n in (4, 30, 200, 1000):
        for _ in range(3):
            base, notice = list(rng.choice(vocab, n)), ["all", "rights", "of", "this", "text", "are", "held", "by", "its", "owner"]
            for changed in (0, 0, n // 200, n // 100, n // 60, n // 40, n // 30, n // 20):
                words = list(base)
                for p in rng.choice(n, changed, replace=False):
                    words[p] = "sub" + str(rng.integers(10**6))
                docs.append((len(docs), " ".join(words + notice * (n > 20))))
    order = rng.permutation(len(docs)).tolist()
    docs = [(order[i], t) for i, t in docs]
    got = {r.doc_id for r in S.keep_one(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    assert got == brute_first(docs) and len(docs) - len(got) > 25


def test_near_dedup_links_by_fingerprints_first(spark, monkeypatch):
    """Near copies of 400 words meet by fingerprints; a pair at 0.8 whose fingerprints are far apart meets by shingles; the result has both."""
    rng = np.random.default_rng(21)
    word = lambda n: ["w%d" % x for x in rng.integers(10**6, size=n)]
    base = [word(400) for _ in range(12)]
    texts = [" ".join(x) for x in base] + [" ".join([*x[:-1], "other"]) for x in base]
    far = word(400)
    texts += [" ".join(far), " ".join([*far[:357], *word(43)])]
    assert ((S.fingerprint(texts[-1].encode(), 5) ^ S.fingerprint(texts[-2].encode(), 5)) & (2**64 - 1)).bit_count() > S.RADIUS
    close = [k for k in range(12) if ((S.fingerprint(texts[k].encode(), 5) ^ S.fingerprint(texts[12 + k].encode(), 5)) & (2**64 - 1)).bit_count() <= S.RADIUS]
    seen, plain = [], S.fingerprint_pairs

    def watched(entries):
        seen.append((plain(entries).count(), entries.select("_hfp").distinct().count()))
        return plain(entries)

    monkeypatch.setattr(S, "fingerprint_pairs", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == [*range(12), 24]
    distinct = len({S.fingerprint(t.encode(), 5) for t in texts})
    assert len(close) >= 4 and len(seen) == 1 and seen[0][0] >= len(close) and seen[0][1] == distinct
