"""URL filter on corner cases, and against the rules tried one by one."""

from epispark.llm.urls import judge_urls

RULES = "host string, path string, verdict string"


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    out = judge_urls(pages, spark.createDataFrame(rules, RULES), **more)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return {r.page_id: tuple(r)[1:] for r in out.collect()}


def test_longest_entry_wins_and_subdomains_count(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("a.example.com", "/en/", "allow")]
    got = judged(spark, [
        "http://example.com/en/1", "http://a.EXAMPLE.com/en/1?q", "http://xexample.com/en/", "http://b.a.example.com/en/",
        "http://example.com", "http://example.com/EN/", "com/en/", None, "", "http://x.org/#com/", "http://com/",
    ], rules)
    assert [got[i][2:] for i in range(11)] == [
        ("example.com/en/", "block"), ("a.example.com/en/", "allow"), ("com/", "allow"), ("a.example.com/en/", "allow"),
        (None, "allow"), ("com/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"),
    ]
    assert got[7][:2] == ("", "") and got[1][:2] == ("a.example.com", "/en/1") and got[4][:2] == ("example.com", "")


def test_a_saturated_filter_changes_no_verdict(spark):
    rules = [(f"h{i}.net", f"/{i}/", "block") for i in range(500)] + [("h1.net", "/1/", None)]
    urls = [f"https://w.h{i}.net/{j}/x" for i in range(0, 700, 7) for j in (i, i + 1)]
    wide, narrow = judged(spark, urls, rules), judged(spark, urls, rules, blocks=1, bits=2)
    assert wide == narrow
    assert [v[3] for v in wide.values()].count("block") == 72


def test_empty_tables_and_repeated_rows(spark):
    assert judged(spark, [], [("com", "/", "block")]) == {}
    assert judged(spark, ["http://a.com/"], [])[0] == ("a.com", "/", None, "allow")
    twice = spark.createDataFrame([(1, "http://a.com/")] * 2, "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("COM", "/", "block")], RULES)
    assert [tuple(r) for r in judge_urls(twice, rules).collect()] == [(1, "a.com", "/", "com/", "block")] * 2
