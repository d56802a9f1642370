import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.functions.similarity import partial_ratio, partial_ratios
from plain import similarity

WORDS = st.text(alphabet="abcdé\U0001f600\0", max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=8))
def test_kernel_equals_plain(pairs):
    got = partial_ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got == pytest.approx([similarity(a, b) for a, b in pairs])


def test_long_terms_and_texts():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abc") for _ in range(n))
    pairs = [(text(m), text(n)) for m in (1, 63, 64, 65, 90) for n in (1, 40, 64, 65, 130)]
    got = partial_ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got == pytest.approx([similarity(a, b) for a, b in pairs])


def test_nulls_and_repeats(spark):
    rows = [("mempcy", "poolmemcpy"), (None, "a"), ("a", None), ("mempcy", "poolmemcpy"), ("", "a")]
    df = spark.createDataFrame(rows, "term string, text string").coalesce(1)
    got = [r[0] for r in df.select(partial_ratio(F.col("term"), F.col("text"))).collect()]
    assert got == [pytest.approx(250 / 3), None, None, pytest.approx(250 / 3), 0.0]
