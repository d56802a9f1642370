"""Resolution in the JVM against the standard library."""

from __future__ import annotations

import random

from docsift.functions import urls
from pyspark.sql import functions as F

BASES = ["http://h", "https://h.org/", "http://h/a/b/c.html", "http://h/a/b/", "http://h:80/a//b/c?q=1#f", "http://h/..", "http://h/a/../b", "http://h/x?y", "http://h#f"]
ODD_BASES = [None, "", "ftp://h/a", "http://h/a;p", "http://[h/a", "HTTP://h/a", "http://u@h/a", "//h/a", "/a/b", "http://h/a b"]
PARTS = ["a", "b.html", "/", "//", ".", "..", "?", "#", "q=1", ":", ";", " ", "é", "[", "http:", "%20", "", "\t", "$", "/../", "/./"]


def test_joins_agree(spark):
    draw = random.Random(5)
    hrefs = ["".join(draw.choices(PARTS, k=draw.randint(0, 7))) for _ in range(1500)] + [None, "", "#", "?", "../..", "../../../x", "a/", "/", "/a/./b/../c/", "a//b", "a\n", "."]
    rows = [(b, h) for h in hrefs for b in draw.sample(BASES, 4) + draw.sample(ODD_BASES, 1)]
    table = spark.createDataFrame(rows, "base string, href string")
    got = table.select("base", "href", urls.plain_join(F.col("base"), F.col("href")).alias("plain"), urls.url_join(F.col("base"), F.col("href")).alias("url")).collect()
    n_plain = 0
    for r in got:
        wanted = urls.resolve(r.base, r.href)
        assert r.url == wanted, r
        assert (r.plain is not None) == urls.is_plain(r.base, r.href), r
        if r.plain is not None:
            assert r.plain == wanted, r
            n_plain += 1
    assert n_plain > 1000


def test_plain_references_need_no_python(spark):
    table = spark.createDataFrame([("http://h/a", "b")], "base string, href string")
    plan = table.select(urls.plain_join(F.col("base"), F.col("href")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
