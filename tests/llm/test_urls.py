"""op7: very long hosts, ties and short hashes that collide."""

import time

from pyspark.sql import functions as F

from touchline.llm import urls


def test_long_hosts_take_no_longer(spark):
    rules = urls.rule_table(spark, urls.RULES)
    one = lambda url: urls.filter_urls(spark.createDataFrame([(1, url)], "page_id bigint, url string"), rules).first()
    one("http://a.com/en/")
    began = time.time()
    got = one("http://" + "a." * 20000 + "example.net/de/8")
    assert (got["rule"], got["verdict"]) == ("example.net/de/8", "block") and time.time() - began < 10


def test_equal_length_goes_to_the_longer_host_then_to_allow(spark):
    rules = urls.rule_table(spark, [("block", "a.com", "/x"), ("allow", "com", "/x/y"), ("block", "org", "/z"), ("allow", "org", "/z")])
    pages = spark.createDataFrame([(1, "s://a.com/x/y"), (2, "s://b.org/z"), (2, "s://b.org/z"), (3, "s://.../x"), (4, "s://b.com/X/Y")], "page_id bigint, url string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages.withColumns({"_host": F.lit(1), "host": F.lit(2)}), rules).fillna("none").collect())
    assert got == [(1, "a.com/x", "block"), (2, "org/z", "allow"), (2, "org/z", "allow"), (3, "none", "allow"), (4, "none", "allow")]


def test_digests_decide_where_short_hashes_meet(spark, monkeypatch):
    rules, pages = urls.rule_table(spark, urls.RULES), spark.createDataFrame([(k, f"s://h{k}.{t}/{p}/{k}") for k in range(40) for t in ("com", "net", "org") for p in ("en", "de", "es")], "page_id bigint, url string")
    want = sorted(map(str, urls.filter_urls(pages, rules).collect()))
    monkeypatch.setattr(urls, "PREFIX", 0)
    assert sorted(map(str, urls.filter_urls(pages, rules).collect())) == want
