"""Phrase mining against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from docsift.llm import phrases
from docsift.operators import bloom

SCHEMA = "doc_id long, text string, lang string, k string, phrase string"


def plain_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, support, most):
    out = []
    f, n = plain_counts(rows)
    for lang, count in f.items():
        long = {p: a for p, a in count.items() if len(p) > 1 and a >= support}
        scored = []
        for p, a in long.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and 100 * m >= 80 * a and inside(q) for q, m in long.items()):
                continue
            score, _, l, r = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    vocabulary = ["in", "The", "the", "of", "Été", "été", "x y", "ß", "\U0001f600", "a-b", "New", "York"]
    texts = [None, "", " \t ", "....", "one", "y" * 200_000, "the of " * 300, "new york city hall. " * 40 + "New york city hall"]
    texts += ["new york city hall"] * 20
    for _ in range(120):
        texts.append("".join(draw.choice(vocabulary) + draw.choice(["  ", " ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(draw.randint(1, 60))))
    order = [*range(len(texts)), 8, 8]
    return [(i if i % 7 else None, texts[k], draw.choice(["en", "de", None, "und"]), "clash", None) for i, k in enumerate(order)]


@pytest.mark.parametrize("sample", [1, 3, 1000])
def test_phrases_against_plain_counting(spark, rows, sample):
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, phrases.collocations(table, 6, 50, sample).collect()))
    wanted = plain(rows, 6, 50)
    assert got == wanted and len(wanted) > 60


def test_every_frequent_phrase_is_counted_once(spark, rows):
    found = phrases.frequent_phrases(spark.createDataFrame(rows, SCHEMA), 5, 2).filter("k > 0").collect()
    got = [(r.lang, tuple(r.phrase.split(" ")), r.f) for r in found]
    wanted = {(lang, p, a) for lang, count in plain_counts(rows)[0].items() for p, a in count.items() if a >= 5}
    assert len(got) == len(wanted) and set(got) == wanted


def test_a_full_filter_only_counts_more(spark, rows, monkeypatch):
    monkeypatch.setattr(bloom, "segments_for", lambda n: 1)
    monkeypatch.setattr(bloom, "contains", lambda table, hashes: np.ones(len(hashes), bool))
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, phrases.collocations(table, 6, 50, 3).collect())) == plain(rows, 6, 50)


def test_products_beyond_64_bits(spark, monkeypatch):
    many = 5 * 10**15
    table = spark.createDataFrame(
        [("en", 0, "", 3 * many), ("en", 1, "a", many + 1), ("en", 1, "b", many + 2), ("en", 2, "a b", many)], "lang string, k int, phrase string, f long"
    )
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: table)
    assert [tuple(r) for r in phrases.collocations(None).collect()] == [
        ("en", 1, "a b", many, many + 1, many + 2, 3 * many, 2000000 * many // (2 * many + 3))
    ]


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", "")], SCHEMA)).count() == 0


def test_parts_that_are_not_proposed_prune(spark):
    import pyarrow as pa

    pieces = phrases.Pieces(pa.array(["a b c d a b"]), pa.array(["en"]))
    known = phrases._filter(spark.createDataFrame([("en", "a"), ("en", "b"), ("en", "c"), ("en", "b c")], "lang string, phrase string"))
    counted = {k: set(pieces.texts(first, k).to_pylist()) for k, first, _ in pieces.counted([known], None)}
    assert counted == {1: {"a", "b", "c", "d"}, 2: {"a b", "b c"}, 3: set(), 4: set()}
    failed = phrases._filter(spark.createDataFrame([("en", "a b")], "lang string, phrase string"))
    counted = {k: set(pieces.texts(first, k).to_pylist()) for k, first, _ in pieces.counted([known], failed)}
    assert {k: found for k, found in counted.items() if found} == {3: {"a b c"}}
    failed = phrases._filter(spark.createDataFrame([("en", "d")], "lang string, phrase string"))
    counted = {k: set(pieces.texts(first, k).to_pylist()) for k, first, _ in pieces.counted([known], failed)}
    assert counted == {2: {"c d", "d a"}, 3: {"b c d", "c d a"}, 4: {"b c d a"}}
