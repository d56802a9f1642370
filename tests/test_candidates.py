import random

import pytest

from pyspark.sql import functions as F

from docsift.operators.candidates import GRAM_SIZES, candidate_pairs, may_reach
from plain import similarity

RNG = random.Random(11)
SYLLABLES = ["me", "m", "co", "py", "as", "ync", "to", "_", "x", "str", "eam", "q", "é", "a", "zz"]
NAMES = sorted({"".join(RNG.choices(SYLLABLES, k=RNG.randint(0, 7))) for _ in range(220)} | {"a", "xy", "z", ""})


def some_terms():
    out = {"".join(RNG.choices(SYLLABLES, k=RNG.randint(1, 4))) for _ in range(40)}
    for name in RNG.sample(NAMES, 40):
        chars = list(name)
        RNG.shuffle(chars)
        out.add("".join(chars[: RNG.randint(1, 9)]))
        out.add(name[RNG.randint(0, 2) : RNG.randint(3, 12)] + RNG.choice(SYLLABLES))
    return sorted(t for t in out if t)


TERMS = some_terms()


@pytest.mark.parametrize("threshold", [0.0, 45.0, 60.0, 66.0, 82.0, 88.0])
@pytest.mark.parametrize("small", [True, False])
def test_no_pair_that_can_pass_is_missed(spark, threshold, small):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    terms = spark.createDataFrame([(t, threshold) for t in TERMS], "term string, threshold double")
    found = candidate_pairs(names, "name", F.col("name"), terms, GRAM_SIZES, threshold, small).collect()
    got = {(r["name"], r["term"]) for r in found}
    assert len(got) == len(found)
    passes = lambda n, t: t in n or (threshold <= 82 and min(82.0, similarity(t, n)) >= threshold)
    must = {(n, t) for n in NAMES for t in TERMS if passes(n, t)}
    assert must <= got
    if threshold > 82:
        assert len(got) < len(NAMES) * len(TERMS) / 3


@pytest.mark.parametrize("threshold", [1.0, 30.0, 50.0, 60.0, 75.0, 82.0])
def test_character_bound_loses_no_pair(spark, threshold):
    pairs = spark.createDataFrame([(n, t) for n in NAMES[::3] for t in TERMS], "name string, term string")
    left_out = pairs.filter(~may_reach(F.col("term"), F.col("name"), F.lit(threshold))).collect()
    assert all(similarity(r["term"], r["name"]) < threshold for r in left_out)
    assert threshold < 60 or len(left_out) > 100


@pytest.mark.parametrize("threshold", [60.0, 70.0, 82.0])
def test_gap_bound_behind_the_pair_tokens(threshold):
    """From 3 characters on some two consecutive matches lie within the distance budget."""
    for m in range(3, 400):
        for w in range(1, m + 1):
            need = -(-threshold * (m + w) // 200)
            if need > w:
                continue
            assert need >= 2
            assert ((m - 1) + (w - 1)) // (need - 1) <= 4
