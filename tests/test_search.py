import random

import pytest
from pyspark.sql import functions as F

from docsift.operators import search as operators
from docsift.operators.search import match_narrow, match_queries, number_queries
from docsift.plans.search import batch_targets, rank_matches, search, search_batch, search_counts
from docsift.schemas import QUERIES, REQUESTS, SYMBOLS
from plain import boolean_rows, fuzzy_rows

RNG = random.Random(23)
WORDS = ["Memory", "memcpy", "Async", "POOL", "svd", "Batch", "gemm", "Tensor", "Qr", "stream"]
ROLE_CHOICES = ["function", "type", "enumerator", "label", "", None, "class"]
SOURCES = ["alpha", "beta", "gamma"]


def make_catalog():
    """Three sources; one URL holds a third of the rows of the first."""
    out = {}
    for s, source in enumerate(SOURCES):
        rows = []
        for pos in range(120):
            name = RNG.choice(["", "_", "::"]).join(RNG.choices(WORDS, k=RNG.randint(1, 3)))
            if RNG.random() < 0.2:
                name += " ( int x )"
            url = None if RNG.random() < 0.1 else f"u{RNG.randint(0, 50)}"
            if s == 0 and pos % 3 == 0:
                url = "hot"
            rows.append({"group": name, "url": url, "role": RNG.choice(ROLE_CHOICES), "domain": RNG.choice(["c", "cpp", None])})
        out[source] = rows
    return out


CATALOG = make_catalog()


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [
        (s, SOURCES.index(s), pos, "inventory", r["group"], r["url"], r["role"], r["domain"], None)
        for s, listed in CATALOG.items()
        for pos, r in enumerate(listed)
    ]
    RNG.shuffle(rows)
    return spark.createDataFrame(rows, SYMBOLS)


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("alpha", 0, None, ["First", "shared"]), ("beta", 1, 72.0, ["second", "SHARED"]), ("gamma", 2, None, None)]
    schema = "name string, source_ord int, match_threshold double, tags array<string>"
    extra = {c: F.lit(None).cast("string") for c in ("doc_type", "doc_url", "index_url")}
    return spark.createDataFrame(rows, schema).withColumns(extra)


def shown(rows):
    return [
        (r["group"], r["url"], r["role"], r["source"], None if r["score"] is None else round(r["score"], 6), r["matched_keyword"])
        for r in sorted(rows, key=lambda r: r["rank"])
    ]


def merged(names, groups, threshold, fuzzy, keep=lambda r: True):
    """names: (canonical, requested) in request order."""
    default = {"beta": 72.0}
    listed = []
    for order, (source, requested) in enumerate(names):
        rows = [r for r in CATALOG[source] if keep(r)]
        if fuzzy:
            cut = threshold if threshold is not None else default.get(source, 60.0)
            found = fuzzy_rows(rows, groups, cut)
        else:
            found = [(r, None, None) for r in boolean_rows(rows, groups)]
        listed += [(order, i, requested, *f) for i, f in enumerate(found)]
    if fuzzy:
        listed.sort(key=lambda x: (-x[4], x[0], x[1]))
    return [
        (r["group"], r["url"], r["role"], requested, None if score is None else round(score, 6), label)
        for _, _, requested, r, score, label in listed
    ]


CASES = [
    ("svd", [["svd"]]),
    ("memory async | gemm", [["memory", "async"], ["gemm"]]),
    ("mmeory | Strem pool", [["mmeory"], ["Strem", "pool"]]),
    ("Q | POOL | POOL", [["Q"], ["POOL"], ["POOL"]]),
    ("svd SVD", [["svd", "SVD"]]),
    ("|", []),
]


@pytest.mark.parametrize("keywords, groups", CASES)
@pytest.mark.parametrize("threshold", [None, 0.0, 83.0, 95.0])
def test_fuzzy_search(symbols, sources, keywords, groups, threshold):
    found = search(symbols, sources, ["shared", "beta"], keywords, True, threshold).collect()
    assert shown(found) == merged([("alpha", "shared"), ("beta", "beta")], groups, threshold, True)


@pytest.mark.parametrize("keywords, groups", CASES)
def test_boolean_search(symbols, sources, keywords, groups):
    found = search(symbols, sources, ["gamma", "alpha"], keywords).collect()
    assert shown(found) == merged([("gamma", "gamma"), ("alpha", "alpha")], groups, None, False)


def test_no_keywords_lists_everything_in_order(symbols, sources):
    found = search(symbols, sources, ["beta", "first"], "  ", True).orderBy("rank").collect()
    assert [r["group"] for r in found] == [r["group"] for s in ("beta", "alpha") for r in CATALOG[s]]
    assert {r["score"] for r in found} == {None}


def test_limit_and_domains(symbols, sources):
    full = merged([("alpha", "alpha")], [["memory"]], 60.0, True, lambda r: r["domain"] == "c")
    found = search(symbols, sources, ["alpha"], "memory", True, 60.0, " c ,x", limit=3).collect()
    assert shown(found) == full[:3]
    with pytest.raises(ValueError, match="at least 1"):
        search(symbols, sources, ["alpha"], limit=0)


def test_unknown_source_fails_first(symbols, sources):
    with pytest.raises(ValueError, match="'nope' not found"):
        search(symbols, sources, ["alpha", "nope"], "svd")


def test_aliases_of_one_source_collapse(symbols, sources):
    found = search(symbols, sources, ["FIRST", "alpha", "Shared"], "svd", True).collect()
    assert {r["source"] for r in found} == {"FIRST"}


def batch(spark):
    queries, requests, expected = [], [], {}
    for i, (keywords, groups) in enumerate(CASES):
        for fuzzy in (True, False):
            for threshold in (None, 65.0, 90.0):
                for limit in (None, 4):
                    qid = f"q{i}-{fuzzy}-{threshold}-{limit}"
                    queries.append((qid, keywords, "all", fuzzy, threshold, limit))
                    names = [("beta", "second"), ("alpha", "alpha")]
                    requests += [(qid, 0, "second"), (qid, 1, "alpha"), (qid, 2, "beta")]
                    expected[qid] = merged(names, groups, threshold, fuzzy)[:limit]
    queries.append(("blank", None, "cpp", True, None, None))
    requests.append(("blank", 0, "gamma"))
    expected["blank"] = [
        (r["group"], r["url"], r["role"], "gamma", None, None) for r in CATALOG["gamma"] if r["domain"] == "cpp"
    ]
    queries.append(("lost", "svd", None, True, None, None))
    requests += [("lost", 0, "alpha"), ("lost", 1, "nope")]
    expected["lost"] = []
    return spark.createDataFrame(queries, QUERIES), spark.createDataFrame(requests, REQUESTS), expected


@pytest.mark.parametrize("max_bytes", [32 << 20, 0])
def test_batch_equals_single_queries(spark, symbols, sources, max_bytes):
    """Both with a broadcast query side and with every join shuffled."""
    queries, requests, expected = batch(spark)
    targets = batch_targets(queries, requests, sources)
    found = rank_matches(match_queries(symbols, targets, max_bytes), targets).collect()
    got = {qid: shown([r for r in found if r["query_id"] == qid]) for qid in expected}
    assert got == expected


def test_limits_only(spark, symbols, sources):
    queries, requests, expected = batch(spark)
    capped = queries.withColumn("max_results", F.lit(2))
    found = search_batch(symbols, sources, capped, requests).collect()
    got = {qid: shown([r for r in found if r["query_id"] == qid]) for qid in expected}
    assert got == {qid: rows[:2] for qid, rows in expected.items()}


def test_counts(spark, symbols, sources):
    queries, requests, expected = batch(spark)
    counted = search_counts(symbols, sources, queries.withColumn("max_results", F.lit(1)), requests).collect()
    whole = {r["query_id"]: r["filtered_count"] for r in counted}
    for qid, rows in expected.items():
        if qid != "lost" and not qid.endswith("-4"):
            assert whole[qid] == len(rows), qid
    assert "lost" not in whole
    assert {r["total_found"] for r in counted if r["query_id"].startswith("q")} == {120}


def test_plan_of_one_query(spark, tmp_path, symbols, sources):
    symbols.write.partitionBy("source").parquet(str(tmp_path / "symbols"))
    stored = spark.read.parquet(str(tmp_path / "symbols"))
    found = search(stored, sources, ["alpha"], "svd batch", True, 90.0, limit=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "(source" in plan.split("PartitionFilters")[1][:80]
    assert "ArrowEvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "TakeOrderedAndProject" in plan

    full = search(stored, sources, ["alpha"], "svd", True, 90.0)
    full.collect()
    plan = full._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan  # ranking reads the matches twice

    similar = search(stored, sources, ["alpha"], "svd | bacth", True, 60.0, limit=5)
    plan = similar._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("max_bytes", [32 << 20, 0])
def test_plan_of_a_batch(spark, symbols, sources, max_bytes):
    queries, requests, _ = batch(spark)
    matches = match_queries(symbols, batch_targets(queries, requests, sources), max_bytes)
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("max_bytes", [32 << 20, 0])
def test_matches_move_only_to_their_ranks(spark, symbols, sources, monkeypatch, max_bytes):
    """Rows of an address meet before they meet the queries, so that no match is shuffled to find the best of an address."""
    queries, requests, _ = batch(spark)
    targets = number_queries(batch_targets(queries.filter("keywords is not null"), requests, sources))
    monkeypatch.setattr(operators, "CROWD", 10**9)  # the hot address is no crowd here
    plan = match_narrow(symbols, targets, max_bytes)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan.split("Generate")[0]


@pytest.mark.parametrize("max_bytes", [32 << 20, 0])
def test_whole_batch_search(spark, symbols, sources, monkeypatch, max_bytes):
    """Ranked from narrow matches, with crowded addresses and packed matches of a name in several rows."""
    monkeypatch.setattr(operators, "CROWD", 3)
    monkeypatch.setattr(operators, "PACK", 10)
    queries, requests, expected = batch(spark)
    found = search_batch(symbols, sources, queries, requests, max_bytes=max_bytes).collect()
    got = {qid: shown([r for r in found if r["query_id"] == qid]) for qid in expected}
    assert got == expected
