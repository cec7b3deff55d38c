import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + j for i in range(len(words) - 4) if counts[tuple(words[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


@settings(max_examples=200, deadline=None)
@given(st.text("ab #<\n\t\x1c\x85\xa0é", max_size=60))
def test_measure(text):
    assert Q.measure(text.encode()) == brute(text)


def test_host_verdicts(spark):
    good, bad = " ".join(map(str, range(50))), "too short"
    rows = [(i, good if i % 10 else bad, "clean") for i in range(160)] + [(1000 + i, bad if i % 10 else good, "spam") for i in range(60)]
    rows += [(300, bad, "tiny"), (301, good, None), (302, None, None), (303, "", "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in Q.judge(docs).collect()}
    assert len(got) == len(rows) and got[1] and not got[0] and not got[1010] and got[301] and not got[302]
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_odd_rows(spark, odd_docs):
    got = Q.judge(odd_docs)
    assert got.count() == odd_docs.count()
    assert got.where(F.col("doc_id") == 0).select("n_words").first()[0] == 0
    assert Q.keep_good(odd_docs).columns == odd_docs.columns
    assert Q.judge(odd_docs.limit(0)).count() == 0 and Q.keep_good(odd_docs.limit(0)).count() == 0
