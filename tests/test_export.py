import json

from pyspark.sql import functions as F

from docsift.plans import export

RESULT = "query_id string, rank int, group string, url string, role string, domain string, source string, score double, matched_keyword string, origin string"


def test_tsv_has_score_columns_only_when_scored(spark, tmp_path):
    rows = [
        ("q", 2, "n", "u", None, None, "s", None, None, None),
        ("q", 1, "a\"b", None, "function", "c", "s", 92.5, "x,y", None),
    ]
    results = spark.createDataFrame(rows, RESULT)
    lines = [r["line"] for r in export.tsv_rows(results).orderBy("rank").collect()]
    assert lines == ['a"b\t\tfunction\tc\ts\t92.5\tx,y', "n\tu\t\t\ts"]
    export.write_tsv(results, str(tmp_path / "out"), ["rank"])
    written = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert written.splitlines() == lines


def test_placeholders(spark):
    status = spark.createDataFrame(
        [("a", "pdf", "u.pdf"), ("b", "no genindex", "docs"), ("c", "no inventory", None), ("d", None, "x"), ("e", "pdf", "")],
        "requested string, skipped_reason string, doc_url string",
    )
    lines = sorted(r["line"] for r in export.tsv_rows(export.placeholder_rows(status)).collect())
    assert lines == ["[PDF manual]\tu.pdf\t\t\ta", "[docs (no inventory)]\tdocs\t\t\tb"]


def test_json_lines(spark, tmp_path):
    rows = [("m", i, f"n{i}", f"u{i}", None, "c", "s1", 90.0, "k", "genindex") for i in range(1, 6)]
    rows += [("s", 1, "n", "u", "type", None, "s1", None, None, None)]
    counts = spark.createDataFrame(
        [("m", 1, "s2", 0, 5), ("m", 0, "s1", 7, 5), ("s", 0, "s1", 9, 1), ("none", 0, "s2", 0, 0)],
        "query_id string, request_ord int, requested string, total_found long, filtered_count long",
    )
    queries = spark.createDataFrame([("m", None), ("s", "c, d"), ("none", "all")], "query_id string, domains string")
    status = spark.createDataFrame(
        [("m", 0, "s1", "sphinx", None, None), ("m", 1, "s2", "pdf", "pdf", "d.pdf"), ("none", 0, "s2", "pdf", "pdf", "d.pdf")],
        "query_id string, request_ord int, requested string, doc_type string, skipped_reason string, doc_url string",
    )
    out = export.json_lines(spark.createDataFrame(rows, RESULT), counts, queries, status)
    got = {(r["query_id"], r["rank"]): json.loads(r["line"]) for r in out.collect()}
    assert sorted(got) == [("m", i) for i in range(6)] + [("none", 0), ("s", 0), ("s", 1)]
    assert got["m", 0] == {
        "sources": ["s1", "s2"],
        "total_found": {"s1": 7, "s2": 0},
        "filtered_count": 5,
        "domains_filter": "all",
        "skipped_sources": {"s2": "d.pdf"},
    }
    assert [got["m", i]["group"] for i in range(1, 6)] == ["n1", "n2", "n3", "n4", "n5"]
    assert "role" not in got["m", 1] and got["m", 1]["score"] == 90.0 and got["m", 1]["origin"] == "genindex"
    assert got["s", 0] == {"source": "s1", "total_found": 9, "filtered_count": 1, "domains_filter": "c, d"}
    assert got["s", 1] == {"group": "n", "url": "u", "role": "type", "source": "s1"}
    none = got["none", 0]
    assert (none["doc_type"], none["doc_url"], none["total_found"]) == ("pdf", "d.pdf", 0) and "'s2'" in none["message"]
    export.write_json(out.filter(F.col("query_id") == "s"), str(tmp_path / "json"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*"))).splitlines()
    assert [json.loads(line) for line in written] == [got["s", 0], got["s", 1]]
