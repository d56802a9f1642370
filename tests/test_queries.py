"""Every registered query against its SQL counterpart on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="benchmark tables not present")


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, name):
    assert check.compare(spark, SF, name).startswith(("ok", "ROWS"))


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns[0] == "rank" and 0 < found.count() <= 20


def test_whole_page_trees(spark):
    rows = entry.queries()["text_tree_pages"](spark, SF).collect()
    assert all(r["status"] == "ok" and r["text_tree"].startswith("html {\n") for r in rows)


def test_stats_leave_out_group_links(spark):
    from docsift.operators.stats import domain_stats
    from docsift.schemas import SYMBOLS

    rows = [
        ("a", 0, 0, "group", "g", "u", None, None, None),
        ("a", 0, 1, "member", "m", "u1", "", "", None),
        ("a", 0, 2, "member", "m", "u2", "", "c", None),
        ("a", 0, 3, "member", "m", "u3", "", "c", None),
        ("b", 1, 0, "index", "i", "u4", "", "c", None),
    ]
    sources = spark.createDataFrame([("a", "doxygen"), ("b", "sphinx_noinv")], "name string, doc_type string")
    got = domain_stats(spark.createDataFrame(rows, SYMBOLS), sources).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("a", "c", 2, 1, 3), ("a", "", 1, 2, 3)]
