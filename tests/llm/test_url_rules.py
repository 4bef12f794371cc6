from compare import compare

from tidemark.llm import url_rules

from .conftest import TABLES

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/", "block"), ("example.net", "/en/x", "block"),
    ("com", "/", "allow"), ("x-y.com", "/", "block"), ("org", "", "block"), ("x.org", "", "allow"),
]


def brute(host: str, path: str):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return max(fits, default=(0, None, "allow"))[1:]


def test_query_agrees_with_sql(spark):
    good, said = compare(spark, "op10", url_rules.query, url_rules.SQL, TABLES)
    assert good, said


def test_nested_rules(spark):
    hosts = ["net", "example.net", "A.example.NET", "b.a.example.net", "badexample.net", "com", "x-y.com", "x.com", "z.x-y.com", "x-y.com.org", "org", "y.x.org", "", "..", ".net", "net.", "xorg", "é.org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x/y?q=/no", "/EN/", "#/en/", "?/en/")]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0]), (1000, None), (1001, "no scheme"), (1002, ""), (1003, "x://y://net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as id", "2 as key", "3 as stack", "4 as part", "'q' as host")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = url_rules.judge_urls(df, rules).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["rule"], r["verdict"]) == brute(r["host"], r["path"]), r
    by = {r["page_id"]: r for r in out}
    assert by[1000]["host"] == by[1001]["path"] == "" and by[1003]["host"] == "y:" and by[1002]["verdict"] == "allow"


def test_no_rules_and_no_urls(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert [(r["rule"], r["verdict"]) for r in url_rules.judge_urls(df, rules.limit(0), default="block").collect()] == [(None, "block")]
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 50_000 + "example.net/en/" + "x" * 1_000_000, "http://" + "b" * 1_000_000 + ".com/de/", "http://example.com/de/" + "/" * 1_000_000, "x" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_rules.judge_urls(df, spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")).collect()
    assert {r["page_id"]: r["rule"] for r in out} == {0: "example.net/en/", 1: None, 2: "example.com/de/", 3: None}
