from gridloom.llm import urls as U

CASES = {
    "http://WWW.Example.NET/en/1": ("www.example.net", "/en/1", "example.net/en/", "allow"),
    "http://example.net/de/1": ("example.net", "/de/1", "net/", "block"),
    "https://a.example.com/de/9?x#y": ("a.example.com", "/de/9", "example.com/de/", "block"),
    "https://badexample.com/de/9": ("badexample.com", "/de/9", None, "allow"),
    "https://m.spam.org/fr/": ("m.spam.org", "/fr/", "org/fr/", "allow"),
    "https://m.spam.org/fr": ("m.spam.org", "/fr", None, "block"),
    "https://spam.org/fr.html?x=1": ("spam.org", "/fr.html", None, "block"),
    "x://net": ("net", "", None, "allow"),
    "net/": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "a?b://c.net/x://y": ("c.net", "/x://y", "net/", "block"),
    "http:///en/": ("", "/en/", None, "allow"),
}


def test_cases(spark):
    rows = [(i, u, "kept", "x") for i, u in enumerate(CASES)]
    pages = spark.createDataFrame(rows + [rows[0]], "page_id long, url string, note string, host string")
    listed = spark.createDataFrame([("spam.org/fr",), ("spam.org/fr",), (None,)], "key string")
    got = U.judge(pages, listed).collect()
    assert len(got) == len(rows) + 1 and {r.note for r in got} == {"kept"}
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == CASES[rows[r.page_id][1]], rows[r.page_id]
    assert U.judge(pages.limit(0), listed).count() == 0
    assert U.judge(pages, listed.limit(0)).where("verdict = 'block' AND rule IS NULL").count() == 0


def test_filter_lets_all_listed_pass(spark):
    keys = spark.range(5000).selectExpr("concat('h', id, '.com/p') AS key")
    pages = spark.range(10_000).selectExpr("id AS page_id", "concat('http://h', id, '.com/p') AS url")
    assert U.judge(pages, keys).where("verdict = 'block'").count() == 5000


def test_only_passed_rows_are_joined(spark, monkeypatch):
    """With lists too long to broadcast, or longer than a broadcast filter: the same verdicts, and refused rows in no shuffle by URL."""
    keys = spark.range(4000).selectExpr("concat('h', id, '.com/p') AS key")
    pages = spark.range(12_000).selectExpr("id AS page_id", "concat('http://h', id, '.com/p') AS url", "id % 3 AS _x").union(spark.sql("SELECT -1L, repeat('http://x', 100000), 0L UNION ALL SELECT -2L, NULL, 0L"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (1 << 20, 4):
            monkeypatch.setattr(U, "MAX_BLOCKS", most)
            out = U.judge(pages, keys)
            got = out.collect()
            assert len(got) == 12_002 and {r.page_id for r in got if r.verdict == "block"} == set(range(4000))
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert plan.startswith("Union") and plan.count("Join LeftOuter, (_ukey") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
