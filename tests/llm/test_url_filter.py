import numpy as np
from pyspark.sql import functions as F

from tickspark.llm import url_filter as u


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    return "".join(c.lower() if c.isascii() else c for c in host), path


URLS = [None, "", "nothing", "http://A.Example.NET/en/x?y#z", "http://example.net", "http://net/", "http://notexample.com/de/", "x://example.com/de/1#?", "https://q.org/fr/a", "https://q.org/FR/a", "http://É.org?x/fr/", "a://b://c/d", "https://casino-win.example.com/", "https://casino-win.example.net/en/1", "http:///p"]


def test_hosts_paths_rules(spark):
    df = spark.createDataFrame([(i, x, "<p>") for i, x in enumerate(URLS)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in u.judge(df).collect()}
    assert len(got) == len(URLS)
    for i, x in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"]) == brute(x), x
    assert [got[i]["rule"] for i in (3, 4, 5, 6, 7, 8, 9, 12, 13)] == ["example.net/en/", None, "net/", None, "example.com/de/", "org/fr/", None, None, "example.net/en/"]
    assert [got[i]["verdict"] for i in (0, 3, 4, 5, 7, 8, 12, 13)] == ["allow", "allow", "allow", "block", "block", "allow", "block", "allow"]


def test_cascade_is_exact_over_its_universe(spark):
    df = spark.range(20000).select(F.concat(F.lit("key"), F.col("id")).alias("key"))
    listed = F.crc32("key") % 7 == 0
    cascade = u.build_cascade(df.union(df.limit(100)), "key", listed)
    got = u.probe(df.withColumn("want", listed), "key", cascade)
    assert got.where("want <> listed").count() == 0 and len(cascade.levels) > 2
    assert got.where("listed").count() == got.where("want").count() > 1000


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(df).count() == 0
    cascade = u.build_cascade(df, "url", F.lit(True))
    assert not cascade.levels and not cascade.listed(np.ones(2, np.uint64), np.ones(2, np.uint64)).any()
