import json

import pytest
from pyspark.sql import functions as F

from docsift.schemas import CRAWL_LOG, REQUESTS, SOURCES
from docsift.sources import registry

FIELDS = SOURCES.fieldNames()


def make(spark, *rows):
    full = [tuple(dict(r, source_ord=i).get(f) for f in FIELDS) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SOURCES)


@pytest.fixture(scope="module")
def sources(spark):
    return make(
        spark,
        dict(name="kernels", doc_type="sphinx", tags=["Sorting", "prim"], inventory_urls=["x"], description="Kernels"),
        dict(name="runtime", doc_type="doxygen", index_url="i"),
        dict(name="prim", doc_type="pdf", doc_url="d", tags=["sorting"]),
    )


def asked(spark, *names, query="q"):
    return spark.createDataFrame([(query, i, n) for i, n in enumerate(names)], REQUESTS)


def test_load(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.json").write_text(json.dumps({"name": "x", "source_ord": 0, "tags": ["t"]}) + "\n")
    loaded = registry.load_registry(spark, str(good))
    assert [(r["name"], r["tags"], r["doc_type"]) for r in loaded.collect()] == [("x", ["t"], None)]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.json").write_text('{"name": "x", \n')
    assert registry.load_registry(spark, str(bad)).startswith("failed to parse registry")
    assert registry.load_registry(spark, str(tmp_path / "none")).startswith("registry not found")
    loaded.write.parquet(str(tmp_path / "table"))
    assert registry.load_registry(spark, str(tmp_path / "table"), "parquet").count() == 1


def test_validate(spark):
    rows = registry.validate_sources(
        make(
            spark,
            dict(name="a", doc_type="sphinx", index_url="x"),
            dict(name="", doc_type="pdf", index_url="x"),
            dict(name="c"),
            dict(name="d", doc_type="wiki", inventory_urls=["u"]),
            dict(name="e", doc_type="sphinx", inventory_urls=[]),
        )
    ).collect()
    assert sorted((r["source_ord"], r["violation"]) for r in rows) == [
        (1, "doc_url is required for pdf"),
        (1, "name is required"),
        (2, "doc_type is required"),
        (2, "inventory_urls or index_url is required"),
        (3, "doc_type is not supported"),
        (4, "inventory_urls or index_url is required"),
    ]


def test_exact_name_wins_over_tag(spark, sources):
    requests = asked(spark, "prim", "SORTING", "Prim", "runtime", "Runtime", "none")
    found = {r["requested"]: r["source"] for r in registry.resolve_requests(requests, sources).collect()}
    assert found == {"prim": "prim", "SORTING": "kernels", "Prim": "kernels", "runtime": "runtime"}
    missing = registry.unknown_sources(requests, sources).collect()
    assert sorted((r["request_ord"], r["requested"]) for r in missing) == [(4, "Runtime"), (5, "none")]


def test_canonical(spark, sources):
    requests = asked(spark, "runtime", "sorting", "kernels", "prim").union(asked(spark, "prim", "nope", query="bad"))
    chosen = registry.canonical_requests(requests, sources).orderBy("request_ord").collect()
    assert [(r["query_id"], r["requested"], r["source"]) for r in chosen] == [
        ("q", "runtime", "runtime"),
        ("q", "sorting", "kernels"),
        ("q", "prim", "prim"),
    ]


def test_list(spark, sources):
    listed = [tuple(r) for r in registry.list_sources(sources).collect()]
    assert listed == [
        ("kernels", "sphinx", "Kernels", ["Sorting", "prim"]),
        ("prim", "pdf", "", ["sorting"]),
        ("runtime", "doxygen", "", []),
    ]


def log(spark, *rows):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    full = [(u, s, f, None, None, day + datetime.timedelta(hours=i)) for i, (u, s, f) in enumerate(rows)]
    return spark.createDataFrame(full, CRAWL_LOG)


def test_first_reachable(spark):
    sources = make(
        spark,
        dict(name="override", override_url="o", inventory_urls=["http://a/x.inv"]),
        dict(name="dead override", override_url="dead", inventory_urls=["dead", "http://a/x.inv"]),
        dict(name="base", inventory_urls=["dead"], base_urls=["gone", "http://b/docs"]),
        dict(name="late", inventory_urls=["http://a/x.inv"], base_urls=["http://b/docs"]),
        dict(name="none", inventory_urls=["dead", "never"], base_urls=["http://c/"]),
    )
    crawl = log(
        spark,
        ("o", 200, "o2"),
        ("dead", 200, "dead"),
        ("dead", 404, "dead"),
        ("http://a/x.inv", 399, "http://a/y.inv"),
        ("http://b/docs", 200, "http://b/v2/index.html"),
        ("http://b/v2/objects.inv", 200, "http://b/v2/objects.inv"),
        ("http://b/objects.inv", 200, "wrong"),
        ("http://c/", 200, "http://c/"),
        ("http://c/objects.inv", None, None),
    )
    found = {r["source"]: r["inventory_url"] for r in registry.first_reachable(sources, crawl).collect()}
    assert found == {
        "override": "o2",
        "dead override": "http://a/y.inv",
        "base": "http://b/v2/objects.inv",
        "late": "http://a/y.inv",
    }


def test_status_and_skipped(spark):
    sources = make(
        spark,
        dict(name="a", doc_type="sphinx"),
        dict(name="b", doc_type="sphinx_noinv", index_url="ib"),
        dict(name="c", doc_type="pdf", index_url="ic"),
        dict(name="d", doc_type="wiki"),
        dict(name="e", doc_type="doxygen"),
        dict(name="f", doc_type="sphinx_noinv", index_url="if"),
    )
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "source string")
    reach = spark.createDataFrame([], "source string, inventory_url string")
    status = registry.source_status(sources, reach, names("f", "f"), names("e"))
    got = {r["source"]: (r["skipped_reason"], r["doc_url"]) for r in status.collect()}
    assert got == {
        "a": ("no inventory", None),
        "b": ("no genindex", "ib"),
        "c": ("pdf", "ic"),
        "d": ("unsupported doc_type: wiki", None),
        "e": ("fetch error", None),
        "f": (None, None),
    }
    asked_for = status.withColumns({"query_id": F.lit("q"), "request_ord": F.col("source_ord"), "requested": F.concat(F.lit("my "), "source")})
    assert registry.skipped_sources(asked_for).first()["skipped_sources"] == {"my b": "ib", "my c": "ic"}
    warnings = {r["source"]: r["warning"] for r in registry.with_warning(asked_for).collect()}
    assert warnings["a"] == "'my a': no valid objects.inv found, skipping"
    assert warnings["b"] == "'my b' (sphinx_noinv): no genindex available, skipping"
    assert warnings["d"] == "'my d': unsupported doc_type 'wiki', skipping"
    assert warnings["f"] is None
