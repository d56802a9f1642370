import datetime

import pytest

from docsift.operators import audit as au
from docsift.schemas import CRAWL_LOG
from test_registry import make

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def crawl(spark):
    rows = [
        ("ok", 404, "ok", None, None, DAY),
        ("ok", 200, "ok", "text/plain", None, DAY + datetime.timedelta(days=1)),
        ("moved", 200, "there", "Text/HTML; charset=x", None, DAY),
        ("gone", 404, "gone", "application/pdf", None, DAY),
        ("err", None, None, None, "timed out", DAY),
        ("empty", 200, "empty", None, None, DAY),
        ("b/objects.inv", 200, "b/objects.inv", None, None, DAY),
    ]
    return spark.createDataFrame(rows, CRAWL_LOG)


def test_url_health(crawl):
    got = {r["url"]: (r["status"], r["ok"], r["redirected_to"], r["content_type"], r["error"]) for r in au.url_health(crawl).collect()}
    assert got["ok"] == (200, True, None, "text/plain", None)
    assert got["moved"] == (200, True, "there", "Text/HTML; charset=x", None)
    assert got["gone"] == (404, False, None, "application/pdf", None)
    assert got["err"] == (None, False, None, "", "timed out")
    assert got["empty"] == (200, True, None, "", None)


def results(spark, crawl, *sources):
    table = make(spark, *sources)
    counts = spark.createDataFrame([("b/objects.inv", 3, "{'c': 3}"), ("there", 1, "{'py': 1}")], "url string, total long, domains string")
    links = spark.createDataFrame([("there", 2), ("ok", 0)], "url string, n_links long")
    rolled = au.roll_up(table, au.all_checks(table, crawl, counts, links))
    return table, rolled


def checks(spark, crawl, *sources):
    """Verdict and checks of each source."""
    _, rolled = results(spark, crawl, *sources)
    return [(r["ok"], [tuple(c) for c in r["checks"]]) for r in rolled.orderBy("source_ord").collect()]


def test_inventory(spark, crawl):
    inv = lambda **urls: dict(name="s", doc_type="sphinx", **urls)
    walked, repeated, moved = checks(
        spark,
        crawl,
        inv(inventory_urls=["gone", "err", "unseen", "empty"], base_urls=["b//", "moved"]),
        inv(inventory_urls=["b/objects.inv"], base_urls=["b/", "b"]),
        inv(inventory_urls=["moved"]),
    )
    assert walked == (
        True,
        [
            ("inventory_url", False, "gone -> 404"),
            ("inventory_url", False, "err -> timed out"),
            ("inventory_url", False, "unseen -> not in crawl log"),
            ("inventory_url", True, "empty"),
            ("inventory_parse", False, "0 objects, domains: {}"),
            ("inventory_url", True, "b/objects.inv"),
            ("inventory_parse", True, "3 objects, domains: {'c': 3}"),
        ],
    )
    assert repeated[0] and len(repeated[1]) == 2
    assert moved[0] and moved[1][0] == ("inventory_url", True, "moved (redirected to there)")


def test_single_page_sources(spark, crawl):
    page = lambda kind, field, url: {"name": "x", "doc_type": kind, field: url}
    got = checks(
        spark,
        crawl,
        *[page("doxygen", "index_url", u) for u in ("moved", "ok", "err")],
        *[page("pdf", "doc_url", u) for u in ("ok", "empty", "moved", "gone", "err")],
        page("sphinx_noinv", "index_url", "ok"),
    )
    html = "moved -> 200 but Content-Type is Text/HTML; charset=x (expected PDF, not HTML) (redirected to there)"
    assert got == [
        (True, [("index_url", True, "moved -> 200 (redirected to there)"), ("group_links", True, "2 group__ links found")]),
        (False, [("index_url", True, "ok -> 200"), ("group_links", False, "0 group__ links found")]),
        (False, [("index_url", False, "err -> timed out")]),
        (True, [("doc_url", True, "ok -> 200, Content-Type: text/plain")]),
        (True, [("doc_url", True, "empty -> 200, Content-Type: unknown")]),
        (False, [("doc_url", False, html)]),
        (False, [("doc_url", False, "gone -> 404, Content-Type: application/pdf")]),
        (False, [("doc_url", False, "HEAD err failed: timed out")]),
        (True, [("index_url", True, "ok -> 200")]),
    ]


MISSING = [
    ("sphinx", "inventory_urls", "no inventory_urls or base_urls defined"),
    ("doxygen", "index_url", "no index_url defined"),
    ("pdf", "doc_url", "no doc_url defined"),
    ("sphinx_noinv", "index_url", "no index_url defined"),
    ("odd", "doc_type", "unsupported doc_type: odd"),
    (None, "doc_type", "unsupported doc_type: unknown"),
]


def test_missing_configuration(spark, crawl):
    got = checks(spark, crawl, *[dict(doc_type=kind, index_url="") for kind, _, _ in MISSING])
    assert got == [(False, [(check, False, detail)]) for _, check, detail in MISSING]


def test_roll_up_headline_and_summary(spark, crawl):
    table, rolled = results(
        spark,
        crawl,
        dict(name="good", doc_type="sphinx_noinv", index_url="ok"),
        dict(name="bad", doc_type="doxygen", index_url="ok"),
        dict(doc_type="pdf", doc_url="gone"),
    )
    lines = {r["source_ord"]: (r["name"], r["status"], r["detail"]) for r in au.headline(rolled).collect()}
    assert lines == {
        0: ("good", "OK", "ok -> 200"),
        1: ("bad", "FAIL", "group_links: 0 group__ links found"),
        2: ("unknown", "FAIL", "doc_url: gone -> 404, Content-Type: application/pdf"),
    }
    assert tuple(au.summary(rolled).first()) == (3, 1, 2)
    only = au.roll_up(table, au.config_checks(table).limit(0), only="good")
    assert only.count() == 0


def test_long_headline_is_cut(spark):
    schema = "source_ord int, name string, doc_type string, ok boolean, checks array<struct<check:string,ok:boolean,detail:string>>"
    rows = [
        (0, "a", "sphinx", True, [("x", True, "a" * 100)]),
        (1, "b", "sphinx", False, [("x", False, "404 not found")]),
        (2, "c", "sphinx", True, [("x", True, "")]),
        (3, "d", "sphinx", True, [("x", True, "a" * 60)]),
        (4, "e", "sphinx", False, []),
    ]
    got = [r["detail"] for r in au.headline(spark.createDataFrame(rows, schema)).orderBy("source_ord").collect()]
    assert got == ["a" * 57 + "...", "x: 404 not found", "", "a" * 60, ""]
