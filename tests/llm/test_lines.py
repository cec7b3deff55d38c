import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import lines as L


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=40), st.text("abcd", max_size=40), st.integers(0, 40))
def test_edit_distance(a, b, most):
    true = plain_distance(a, b)
    assert L.edit_distance(a, b) == true
    got = L.edit_distance(a, b, most)
    assert got == true if true <= most else got > most


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "cab", "ddd", "e"]), min_size=1, max_size=9), st.lists(st.sampled_from(["a", "bb", "cab", "ddd", "f"]), min_size=1, max_size=9))
def test_bound_is_never_below_the_distance(x, y):
    assert L.distance_bound(x, y) >= plain_distance(" ".join(x), " ".join(y))


def test_edit_distance_of_long_lines_with_a_limit():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = "".join(rng.choice(list("abcde"), int(rng.integers(150, 400))))
        b = list(a) if rng.random() < 0.7 else list(rng.choice(list("abcde"), 300))
        for _ in range(int(rng.integers(0, 90))):
            k = int(rng.integers(len(b)))
            b[k : k + int(rng.integers(0, 2))] = rng.choice(list("abcde"), int(rng.integers(0, 2))).tolist()
        true, most = plain_distance(a, "".join(b)), int(rng.integers(0, 120))
        got = L.edit_distance(a, "".join(b), most)
        assert got == true if true <= most else got > most


def norm(line):
    return b" ".join(re.findall(rb"(?:[a-z0-9]|[\x80-\xff])+", re.sub(rb"[0-9]", b"0", line.lower().encode())))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB0 7.,\n\té😀", max_size=30), min_size=1, max_size=4))
def test_normalise(docs):
    doc, number, start, end, buf = L.split_lines([d.lower().encode() for d in docs])
    got = [(int(d), int(n), buf[s:e].tobytes()) for d, n, s, e in zip(doc, number, start, end)]
    assert got == [(i, j, norm(x)) for i, d in enumerate(docs) for j, x in enumerate(d.split("\n")) if norm(x)]


def test_majority():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 1500, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    counts = np.array([1, 2, 7, 255, 256, 600, 379])
    first = np.cumsum(counts) - counts
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[i : i + n]) > n) for i, n in zip(first, counts)]
    assert [int(x) for x in L.majority(h, first, counts)] == want


def normal_lines(docs):
    """(order, normalised line) of every line with a word."""
    return [((i is None, i or 0, k, j), norm(x)) for k, (i, t) in enumerate(docs) for j, x in enumerate((t or "").split("\n")) if norm(x)]


def buffer(lines):
    sizes = np.array([len(x) for x in lines])
    start = np.cumsum(sizes + 1) - sizes
    return np.frombuffer(b"\n" + b"\n".join(lines) + b"\n", np.uint8), start, start + sizes


def grouped(lines, links):
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {x: find(x) for x in lines}


def candidate_links(lines):
    """The links of one sort in one process."""
    prints, at, key = L.signatures(*buffer(lines))
    rows = np.stack([key.view(np.int64), L.line_names(*buffer(lines))[at, 0], prints.view(np.int64)[at]], 1)
    by = {h: x for h, x in zip(L.line_names(*buffer(lines))[:, 0].tolist(), lines)}
    rows = np.unique(rows, axis=0)
    pairs = [(by[a], by[b]) for a, b in zip(*(x.tolist() for x in L.candidates(rows)))]
    return [(a, b) for a, b in pairs if L.alike([a], [b])[0] and plain_similar(a, b)]


def plain_similar(a, b):
    a, b = a.decode(), b.decode()
    return 5 * plain_distance(a, b) <= max(len(a), len(b))


def brute(docs):
    """The groups of one sort in one process, and the first line of each."""
    rows = normal_lines(docs)
    lines = sorted({x for _, x in rows})
    group = grouped(lines, candidate_links(lines)) if lines else {}
    keep = {}
    for at, x in rows:
        keep[group[x]] = min(keep.get(group[x], at), at)
    gone = {at for at, x in rows if keep[group[x]] != at}
    out = []
    for k, (i, text) in enumerate(docs):
        parts = (text or "").split("\n")
        stay = [x for j, x in enumerate(parts) if (i is None, i or 0, k, j) not in gone]
        out.append((i, len(parts), len(parts) - len(stay), text if len(stay) == len(parts) else "\n".join(stay)))
    return out


def planted(n=40):
    rng = np.random.default_rng(8)
    pool = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(int(rng.integers(1, 40)))) for _ in range(25)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            line = pool[int(rng.integers(25))]
            if rng.random() < 0.5 and len(line) > 20:
                k = int(rng.integers(len(line)))
                line = line[:k] + "z" + line[k + int(rng.integers(0, 2)) :]
            parts.append(line.title() + "!" if rng.random() < 0.3 else line)
        docs.append((i, "\n".join(parts)))
    return docs + [(None, pool[0]), (7, pool[1] + "\n\n" + pool[1])]


def removed(spark, docs):
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    return [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in got]


def all_links(lines):
    """The links among all pairs of lines that share a key, with no order or grouping of the module's."""
    prints, at, key = L.signatures(*buffer(lines))
    sharing = {}
    for i, k in zip(at.tolist(), key.tolist()):
        sharing.setdefault(k, set()).add(i)
    pairs = {(i, j) for x in sharing.values() for i in x for j in x if i < j and (int(prints[i]) ^ int(prints[j])).bit_count() <= L.RADIUS}
    return [(lines[i], lines[j]) for i, j in pairs if L.alike([lines[i]], [lines[j]])[0] and plain_similar(lines[i], lines[j])]


def test_all_lines_of_a_crowded_key_meet(spark):
    """Few words make all lines, so that each key has very many; groups are those of all pairs."""
    rng = np.random.default_rng(3)
    long = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(7)]
    short = ["".join(rng.choice(list("klmnopqr"), 9)) for _ in range(25)]
    lines = sorted({" ".join([long[k] for k in sorted(rng.choice(7, 5, replace=False))] + [short[k] for k in rng.integers(25, size=2)]) for _ in range(350)})
    group = grouped([x.encode() for x in lines], all_links([x.encode() for x in lines]))
    size = {g: list(group.values()).count(g) for g in group.values()}
    assert max(size.values()) < len(lines) and sum(size.values()) - len(size) > 20
    gone = sum(x[2] for x in removed(spark, list(enumerate(lines))))
    assert gone == len(lines) - len(size)


def test_comparisons_of_a_large_key_are_dealt_in_squares(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 6, dtype=np.int64)
    fp = [int(base[k % 6]) ^ sum(1 << int(b) for b in rng.choice(62, 9, replace=False)) for k in range(90)]
    group = [k % 6 if k % 4 == 0 else 1000 + k for k in range(90)]
    rest = spark.createDataFrame([(7, k, fp[k], 90) for k in range(90)], "key long, e long, fp long, m long")
    parts = spark.createDataFrame(list(enumerate(group)), "node long, component long")
    monkeypatch.setattr(L, "TILE", 8)
    near = {(i, j) for i in range(90) for j in range(i + 1, 90) if group[i] != group[j] and ((fp[i] ^ fp[j]) & (2**64 - 1)).bit_count() <= L.RADIUS}
    assert {tuple(r) for r in L.met_groups(rest, parts, False).collect()} == near and len(near) > 100
    some = {tuple(r) for r in L.met_groups(rest, parts, True).collect()}
    assert some <= near and {(i, group[j]) for i, j in near} | {(j, group[i]) for i, j in near} == {(i, group[j]) for i, j in some} | {(j, group[i]) for i, j in some}


def test_a_square_gives_out_fewer_links_than_it_has_lines():
    """All lines of a square are near by SimHash, few are similar: links unite the groups of all pairs, and no row is made for the others."""
    rng = np.random.default_rng(9)
    base = ["".join(rng.choice(list("abcdefgh "), 60)) for _ in range(40)]
    lines = [(x[:7] + "z" * int(k) + x[7:]).encode() for x in base for k in range(3)]
    n = len(lines)
    fixed = {"key": 7, "i": 0, "j": 0, "part": 0, "fp": 5, "more": 9}
    columns = {c: pa.array(np.full(n, v)) for c, v in fixed.items()} | {"e": pa.array(range(n)), "chars": pa.array([len(x) for x in lines]), "group": pa.array(range(n)), "body": pa.array(lines)}

    def links(keys):
        batch = pa.RecordBatch.from_pydict(columns | {"keys": pa.array(keys)})
        return [p for x in L.square_links(iter([batch.slice(0, 50), batch.slice(50)])) for p in zip(x.column("a").to_pylist(), x.column("b").to_pylist())]

    got = grouped(range(n), links([[7, 8]] * n))
    want = grouped(range(n), [(a, b) for a in range(n) for b in range(a) if plain_similar(lines[a], lines[b])])
    assert [[got[a] == got[b] for b in range(n)] for a in range(n)] == [[want[a] == want[b] for b in range(n)] for a in range(n)]
    assert len(links([[7, 8]] * n)) == n - len(set(want.values())) >= 80
    assert links([[7, 3]] * n) == []  # they met in square 3
    assert len(links([[7, 3] if k % 3 == 0 else [7] for k in range(n)])) == 80  # of each three, two pairs meet here only


@pytest.mark.parametrize("split", [False, True])
def test_planted(spark, split):
    """Also with one partition for each bit of the sort, whose edges lie between tasks."""
    docs = planted()
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"} if split else {}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = removed(spark, docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3] or "")
    assert sorted(got, key=key) == sorted(brute(docs), key=key)
    assert sum(r[2] for r in got) > 20


def test_recall_against_plain_edit_similarity(spark):
    """Lines that a plain comparison of all pairs links are in one group for nine of ten pairs, whatever was edited; others never are."""
    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(900)]
    kinds, lines = {}, []
    for n in (5, 8, 12, 20, 45, 90):
        for edit in ("character", "word", "two words", "a tenth"):
            for _ in range(12):
                a = [vocab[k] for k in rng.integers(len(vocab), size=n)]
                b = list(a)
                places = rng.choice(n, {"character": 1, "word": 1, "two words": 2}.get(edit, max(1, n // 10)), replace=False)
                for k in places:
                    b[k] = b[k][:-1] + "z" if edit == "character" else vocab[rng.integers(len(vocab))]
                a, b = " ".join(a), " ".join(b)
                if a != b and plain_similar(a.encode(), b.encode()):
                    kinds.setdefault(edit, []).append((a, b))
                    lines += [a, b]
    order = rng.permutation(len(lines)).tolist()
    docs = [(i, lines[k]) for i, k in enumerate(order)]
    gone = {t: r for (i, t), r in zip(docs, [x[2] for x in sorted(removed(spark, docs))])}
    for edit, pairs in kinds.items():
        found = sum(gone[a] + gone[b] == 1 for a, b in pairs)
        assert found >= 0.9 * len(pairs) and len(pairs) > 30, (edit, found, len(pairs))
    assert sum(gone.values()) <= sum(map(len, kinds.values()))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()][:60]
    assert sorted(removed(spark, docs)) == sorted(brute(docs))
    assert L.op1_line_dedup(spark, sf).count() == 200


def test_odd_rows(spark, odd_docs):
    got = L.dedup_lines(odd_docs)
    assert got.count() == odd_docs.count() and set(odd_docs.columns) <= set(got.columns)
    assert got.where("doc_id = 3 and text = ''").count() == 2 and got.where("doc_id = 3 and text = 'one'").count() == 1
    assert got.where("text is null and n_lines = 1 and n_removed = 0").count() >= 1
    assert L.dedup_lines(odd_docs.limit(0)).count() == 0
