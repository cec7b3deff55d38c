import io

import pytest

from gridloom.llm import warc as A
from gridloom.llm.common import fresh_path


def brute(rows):
    best = {}
    for page, html in rows:
        key = html or ""
        best[key] = max(best.get(key, -1), page if page is not None else -1)
    return {(p, len((h or "").encode()), A.digest((h or "").encode()), "response" if best[h or ""] == p else "revisit", None if best[h or ""] == p else best[h or ""]) for p, h in rows}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = A.op5_warc(spark, sf).collect()
    assert len(got) == len(pages) and {tuple(r) for r in got} == brute([tuple(r) for r in pages])


def test_copies_nulls_and_ties(spark):
    rows = [(1, "u", "same"), (5, "u\n", "same"), (3, None, "same"), (7, "u", None), (8, "u", ""), (9, "é", "x" * 400_000), (None, "u", "lone"), (10, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = fresh_path(spark, "warc")
    got = A.read_archives(A.write_archives(pages, folder), folder, payloads=True).collect()
    assert {tuple(r)[:5] for r in got if r.page_id is not None} == {x for x in brute([(r[0], r[2]) for r in rows]) if x[0] is not None}
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}[5] == "same"
    folder = fresh_path(spark, "warc")
    twice = A.read_archives(A.write_archives(pages.where("page_id = 5").union(pages.where("page_id = 5")), folder), folder).collect()
    assert sorted((r.record_type, r.refers_to) for r in twice) == [("response", None), ("revisit", 5)]
    folder = fresh_path(spark, "warc")
    assert A.read_archives(A.write_archives(pages.limit(0), folder), folder).count() == 0


def test_reader_refuses_damage():
    good = A.record("u", 1, 2, b"payload" * 100, None) + A.record("u", 3, 4, b"", None)
    assert [A.read_record(r)[0] for r in A.members(io.BytesIO(good), 7)] == [1, 3]
    with pytest.raises(ValueError):
        list(A.members(io.BytesIO(good[:-9])))
    raw = next(A.members(io.BytesIO(good)))
    with pytest.raises(ValueError):
        A.read_record(raw.replace(b"payload", b"PAYLOAD", 1))
