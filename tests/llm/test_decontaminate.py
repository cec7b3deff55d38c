import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np

from gridloom.llm import decontaminate as D


def words(text):
    return re.findall(rb"(?:[a-z0-9]|[\x80-\xff])+", (text or "").lower().encode())


def brute(docs, items):
    """Pairs by laying each item at every offset of each document: no seeds, no scores."""
    return {(i, j) for i, text in docs for j, item in items if len(words(item)) >= D.SPAN and plain_overlap(words(text), words(item))}


def test_seeds_find_two_substitutions_in_twelve_words():
    for bad in combinations(range(D.LEAST), 2):
        assert any(all(p + o not in bad for o in s) for s in D.SEEDS for p in range(D.LEAST - s[-1])), bad


def test_planted(spark, odd_docs):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(300)]
    draw = lambda n: list(rng.choice(vocab, n))
    items = [(j, " ".join(draw(int(rng.integers(11, 40))))) for j in range(12)] + [(90, None), (91, ""), (92, "too few words"), (0, "an item whose id is used twice by another one " * 2)]
    docs = []
    for i in range(60):
        text = draw(int(rng.integers(0, 80)))
        if i % 3 == 0:
            p = items[i % 12][1].split()
            for k in rng.choice(len(p), int(rng.integers(0, 1 + len(p) // 6)), replace=False):
                p[k] = "sub"
            text += p[: len(p) if i % 2 else 14] + draw(5)
        docs.append((i, ", ".join(text).upper() if i % 4 == 0 else " ".join(text)))
    docs += [docs[0], (99, None), (98, "")]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert all(r.similarity >= 0.8 for r in got)
    kept = D.drop_contaminated(odd_docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert D.contaminated(odd_docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert D.contaminated(odd_docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in D.op9_decontaminate(spark, sf).collect()}
    want = {(i, j) for i, t in docs for j, b in items if b in (t or "")}
    assert want <= got and len(got) <= len(want) + 1


def plain_overlap(w, v):
    """Whether some stretch of 12 words or more, or all of a shorter item, has 0.8 matching words at some offset. No seeds, no scores."""
    least = min(12, len(v))
    if 5 * sum(x in set(w) for x in v) < 4 * least:
        return False
    places = {}
    for i, x in enumerate(w):
        places.setdefault(x, []).append(i)
    shifts = Counter(i - j for j, y in enumerate(v) for i in places.get(y, ()))
    for shift in (x for x, n in shifts.items() if 5 * n >= 4 * least):
        same = [0 <= k + shift < len(w) and w[k + shift] == v[k] for k in range(len(v))]
        inside = [0 <= k + shift < len(w) for k in range(len(v))]
        upto = [0, *np.cumsum(same).tolist()]
        for a in range(len(v)):
            for b in range(a + least, len(v) + 1):
                if inside[a] and inside[b - 1] and 5 * (upto[b] - upto[a]) >= 4 * (b - a):
                    return True
    return False


def test_seeds_cover_the_shortest_stretches():
    for seeds, cases in ((D.SEEDS, ((12, 2), (15, 3), (20, 4))), (D.SHORT, ((6, 1), (7, 1), (8, 1), (9, 1), (10, 2), (11, 2)))):
        for n, m in cases:
            for bad in combinations(range(n), m):
                assert any(all(p + o not in bad for o in s) for s in seeds for p in range(n - s[-1])), (n, bad)


def test_substitutions_end_to_end(spark):
    rng = np.random.default_rng(5)
    fresh = (f"u{i}" for i in range(10**6))
    items = [(0, [next(fresh) for _ in range(30)])] + [(n, [next(fresh) for _ in range(n)]) for n in (6, 7, 9, 11, 12, 60)]
    passages = [(items[0][1][9:21], bad) for m in (0, 1, 2, 3) for bad in combinations(range(12), m)][:150]
    passages += [(items[0][1][5:20], tuple(rng.choice(15, 3, False))) for _ in range(30)] + [(items[0][1], tuple(rng.choice(30, 6, False))) for _ in range(30)]
    passages += [(v, bad) for n, v in items[1:6] for m in (0, 1, 2) for bad in combinations(range(n), m)]
    passages += [(items[6][1], tuple(range(k, 60, 5))) for k in range(5)]
    docs = []
    for i, (p, bad) in enumerate(passages):
        text = [next(fresh) if k in bad else x for k, x in enumerate(p)]
        docs.append((i, [next(fresh) for _ in range(4)] + text + [next(fresh) for _ in range(4)]))
    want = {(i, j) for i, w in docs for j, v in items if set(w) & set(v) and plain_overlap(w, v)}
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(x)) for i, x in rows], f"{name} long, text string")
    got = D.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 200
    assert all(r.similarity >= 0.8 for r in got)


def test_repetitive_texts(spark):
    """A long text of one word against many items of the same word, and texts of a few words repeated."""
    items = [(j, "same " * (100 + j % 7)) for j in range(200)] + [(900, "ab cd " * 40), (901, "ab cd ef " * 30)]
    docs = [(0, "same " * 20_000), (1, "ab cd " * 3000), (2, "same other " * 50), (3, "ab cd ef " * 4 + "x")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    start = time.time()
    got = D.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert time.time() - start < 60
    pairs = {(r.doc_id, r.item_id): (r.doc_word, r.item_word, r.n_words, r.n_match) for r in got}
    assert pairs == {(0, j): (0, 0, 100 + j % 7, 100 + j % 7) for j in range(200)} | {(1, 900): (0, 0, 80, 80), (3, 901): (0, 78, 12, 12)}
    assert len(got) == len(pairs)


def test_many_offsets_at_a_time():
    """best_of() over random texts of few words equals one offset after the other."""
    r = random.Random(3)
    for _ in range(1500):
        v, m, n = r.choice([2, 3, 30]), r.choice([1, 3, 6, 8, 13, 30, 60]), r.choice([1, 5, 20, 80, 200])
        item, doc = (np.array([r.randrange(v) for _ in range(k)], np.uint64) for k in (m, n))
        if n > m and r.random() < 0.6:
            at = r.randrange(n - m + 1)
            doc[at : at + m] = item
            for _ in range(m // 6):
                doc[at + r.randrange(m)] = 99
        shifts = np.arange(-m, n + 1)
        shifts = shifts if r.random() < 0.5 else np.array(sorted(r.sample(shifts.tolist(), len(shifts) // 2)), np.int64)
        found = [(same, -a, b, k) for a, b, k, same in (D.best_overlap(doc, item, s) for s in shifts.tolist()) if k >= min(D.LEAST, m)]
        want = None if not found else (-max(found)[1], *max(found)[2:], max(found)[0])
        assert D.best_of(doc, item, shifts) == want


def test_offsets_are_all_differences():
    r = np.random.default_rng(4)
    for _ in range(50):
        shared = [(np.sort(r.choice(50, r.integers(1, 9), False)), np.sort(r.choice(20, r.integers(1, 9), False))) for _ in range(3)]
        assert D.offsets(50, 20, shared).tolist() == sorted({p - a for places, ats in shared for p in places.tolist() for a in ats.tolist()})


def test_tiny_items_count_whole(spark):
    items = [(1, "alpha"), (2, "alpha beta"), (3, "one two three four five"), (4, "")]
    docs = [(0, "Beta, alpha"), (1, "x alpha beta"), (2, "one two three four six"), (3, "so one two three four five."), (4, None)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    docs, items = frame(docs, "doc_id"), frame(items, "item_id")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} == {(0, 1), (1, 1), (1, 2), (3, 3)}
    assert D.drop_contaminated(docs, items).count() == 5


def test_query_equals_plain_overlaps(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id) for r in D.op9_decontaminate(spark, sf).collect()} == brute(docs, items)
