import random

import pytest
from pyspark.sql import functions as F

from docsift.operators.ranking import add_rank, first_by
from docsift.operators.sizing import broadcast_if_small, measured_bytes


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    # One group holds most of the rows.
    rows = [(rng.choice("aaaaaab"), float(rng.choice([1, 2, 2, 2, 3])), pos) for pos in rng.sample(range(5000), 1500)]
    return rows, spark.createDataFrame(rows, "g string, k double, pos long")


def expected(rows):
    out = {}
    for g in "ab":
        mine = sorted((k, p) for x, k, p in rows if x == g)
        out.update({(g, k, p): i + 1 for i, (k, p) in enumerate(mine)})
    return out


@pytest.mark.parametrize("bits", [0, 4, 20])
def test_rank_by_blocks(scored, bits):
    rows, df = scored
    got = {(r["g"], r["k"], r["pos"]): r["rank"] for r in add_rank(df, ["g"], ["k"], "pos", block_bits=bits).collect()}
    assert got == expected(rows)


def test_rank_without_groups_and_with_huge_positions(spark):
    rows = [(float(i % 3), (1 << 60) + i * 7) for i in range(200)]
    df = spark.createDataFrame(rows, "k double, pos long")
    got = [(r["k"], r["pos"]) for r in add_rank(df, [], ["k"], "pos", block_bits=3).orderBy("rank").collect()]
    assert got == sorted(rows)


def test_limit_keeps_the_first(scored):
    rows, df = scored
    ranked = add_rank(df, ["g"], ["k"], "pos", limit=7)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
    got = {(r["g"], r["k"], r["pos"]): r["rank"] for r in ranked.collect()}
    assert got == {key: rank for key, rank in expected(rows).items() if rank <= 7}


def test_first_by_merges_on_the_map_side(scored):
    rows, df = scored
    best = first_by(df, ["g"], ["k", "pos"], n=F.count("pos"))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
    got = {r["g"]: (r["k"], r["pos"], r["n"]) for r in best.collect()}
    want = {g: (*min((k, p) for x, k, p in rows if x == g), sum(x == g for x, _, _ in rows)) for g in "ab"}
    assert got == want
    latest = {r["g"]: (r["k"], r["pos"]) for r in first_by(df, ["g"], ["k", "pos"], last=True).collect()}
    assert latest == {g: max((k, p) for x, k, p in rows if x == g) for g in "ab"}


def test_broadcast_rests_on_the_measured_size(scored):
    _, df = scored
    size = measured_bytes(df)
    assert size > 20_000
    assert broadcast_if_small(df, size)[1] and not broadcast_if_small(df, size - 1)[1]
