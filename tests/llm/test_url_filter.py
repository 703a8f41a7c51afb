import data
from quaestor.llm import url_filter as u
from quaestor.llm.queries import URL_RULES


def judge(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    return {r["page_id"]: r for r in u.url_filter(pages, URL_RULES).collect()}


def test_host_path_and_rule(spark):
    urls = ["http://A.Example.NET/en/1?q=/x", "https://sub.example.com/de/", "http://x.net", "http://x.net/", "http://net/a", "http://notnet/a",
            "nothing", None, "", "ftp://x.org/fr/#y", "http://x.org/f", "a://b://c/d", "http://example.com?x=/de/", "HTTP://EXAMPLE.com/de/#"]
    got = judge(spark, urls)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [
        ("a.example.net", "/en/1", "example.net/en/"), ("sub.example.com", "/de/", "example.com/de/"), ("x.net", "", None), ("x.net", "/", "net/"),
        ("net", "/a", "net/"), ("notnet", "/a", None), ("", "", None), ("", "", None), ("", "", None), ("x.org", "/fr/", "org/fr/"),
        ("x.org", "/f", None), ("b:", "//c/d", None), ("example.com", "", None), ("example.com", "/de/", "example.com/de/")]
    assert got[0]["verdict"] == "allow" and got[1]["verdict"] == "block"


def test_longest_rule_wins_then_smaller(spark):
    rules = {"b.com/": "block", "a.b.com/": "allow", "b.com/x": "allow", "b.com/xy": "block"}
    pages = spark.createDataFrame([("http://a.b.com/q",), ("http://a.b.com/xyz",), ("http://b.com/xa",)], "url string")
    got = [r["rule"] for r in u.url_filter(pages, rules).orderBy("url").collect()]
    assert got == ["a.b.com/", "a.b.com/", "b.com/x"]


def test_model_tells_classes_apart(spark):
    urls = [f"http://good{i}.example.net/en/page{i}" for i in range(200)] + [f"http://spam{i}.net/xxx{i}" for i in range(200)]
    urls += ["http://good7.somewhere.io/en/page9", "http://spam3.somewhere.io/xxx5"]
    got = judge(spark, urls)
    assert [got[400]["verdict"], got[401]["verdict"]] == ["allow", "block"]


def test_no_examples_repeats_and_clashes(spark):
    pages = data.with_clashes(spark.createDataFrame([(1, "http://q.io/a"), (1, "http://q.io/a"), (2, None)], "page_id int, url string"))
    rows = u.url_filter(pages, URL_RULES).collect()
    assert len(rows) == 3 and {(r["verdict"], r["score"]) for r in rows} == {("allow", 0.0)}
    assert u.url_filter(data.empty(pages), URL_RULES).count() == 0
