import duckdb
import pytest

from gridloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda r: tuple((x is None, 0 if x is None else x) for x in r)
    a = sorted([tuple(r[c] for c in cols) for r in got.collect()], key=key)
    b = sorted(want.select(*cols).fetchall(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c, u, v in zip(cols, x, y):
            assert u == (pytest.approx(v, rel=1e-7, abs=1e-9) if isinstance(v, float) else v), (c, x, y)


def test_group_kfold_is_the_greedy_one(spark):
    rows = sorted((-r["n"], r["block"], r["fold"]) for r in catalog.QUERIES["c03_group_kfold"](spark, SF).collect())
    load = [0] * 5
    for n, _, fold in rows:
        assert fold == load.index(min(load))
        load[fold] -= n
    assert sum(load) == catalog.QUERIES["c02_block_id"](spark, SF).count()
