import json
import random

import pytest
from pyspark.sql import functions as F

from docsift.functions import text as tx
from docsift.operators.search import name_forms, split_keywords, tier_of, with_similarity
from plain import pieces, term_score


def column(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


DRAW = random.Random(11)
PARTS = ["ab", "Cd", "EF", "gh2", "XYz", "q", "R", "7", "éa", "Ü"]
NAMES = ["", " "] + ["".join(DRAW.choice(PARTS) + DRAW.choice(["", "", "_", "::", "-", "__", " ", "."]) for _ in range(DRAW.randint(1, 5))) for _ in range(60)]


def test_segments(spark):
    assert column(spark, NAMES, tx.segments) == [pieces(n) for n in NAMES]


def test_bare_name(spark):
    got = column(spark, ["free ( void* p )", "x", " y\t(", "(z)", " n "], tx.bare_name)
    assert got == ["free", "x", "y", "", "n"]


def test_term_score(spark):
    names = [n + DRAW.choice(["", "(int x)", " ( ab )"]) for n in NAMES if n.strip()]
    rows = []
    for name in names:
        begin = DRAW.randrange(len(name))
        piece = name[begin : begin + DRAW.randint(1, 6)].strip() or "zz"
        rows += [(DRAW.choice([piece, piece.upper(), name, name[::-1].strip() or "k", DRAW.choice(PARTS)]).lower(), name)]
    df = name_forms(spark.createDataFrame(rows, "term string, group string")).withColumn("_tier", tier_of(F.col("term")))
    got = df.select("term", "group", with_similarity(F.col("_tier"), F.col("term"), F.lit(True))).collect()
    assert [r[2] for r in got] == pytest.approx([term_score(r[0], r[1]) for r in got])
    assert len({r[2] for r in got}) > 4


def test_missing_name_scores_nothing(spark):
    df = name_forms(spark.createDataFrame([(None,), ("ab",)], "group string")).withColumn("_tier", tier_of(F.lit("zz")))
    assert df.filter("group is null").select(with_similarity(F.col("_tier"), F.lit("zz"), F.lit(True))).first()[0] is None


def test_segment_mark_in_a_name_is_no_boundary(spark):
    df = name_forms(spark.createDataFrame([("ab\x1fcd",)], "group string"))
    assert df.select(tier_of(F.lit("cd"))).first()[0] == 88.0


def grouped(query):
    """The rule as a loop over words: a lone bar ends a group."""
    groups = [[]]
    for word in query.split():
        groups = [*groups, []] if word == "|" else [*groups[:-1], [*groups[-1], word]]
    return [g for g in groups if g]


TOKENS = ["|", "|", "x", "Yy", "z|w", "||", "k9"]
QUERIES = ["".join(DRAW.choice(TOKENS) + DRAW.choice([" ", "  ", "\t", "\n"]) for _ in range(DRAW.randint(1, 6))) for _ in range(40)]


def test_or_groups(spark):
    assert column(spark, QUERIES, tx.or_groups) == [grouped(q) for q in QUERIES]
    assert [split_keywords(spark, q) for q in QUERIES[:3]] == [grouped(q) for q in QUERIES[:3]]


def test_empty_query_is_not_a_pipe(spark):
    assert column(spark, [None, "", "  ", "|"], tx.has_keywords) == [False, False, False, True]
    assert split_keywords(spark, "  ") is None and split_keywords(spark, "|") == []


def test_domain_set(spark):
    got = column(spark, [None, "all", "ALL", "cpp, py", "", " ,c,"], tx.domain_set)
    assert got == [None, None, None, ["cpp", "py"], [], ["c"]]


def test_domain_filter_exempts_group_links(spark):
    rows = [("inventory", "c"), ("inventory", None), ("group", None), ("member", "py")]
    df = spark.createDataFrame(rows, "kind string, domain string")
    keep = lambda wanted: [r[0] for r in df.select(tx.in_domains(F.col("kind"), F.col("domain"), wanted)).collect()]
    assert keep(F.array(F.lit("c"))) == [True, False, True, False]
    assert keep(F.array().cast("array<string>")) == [False, False, True, False]
    assert keep(F.lit(None).cast("array<string>")) == [True] * 4


def test_role_adjust(spark):
    roles = ["function", "type", "enum", "macro", "enumerator", "data", "label", "", None, "class"]
    got = column(spark, roles, lambda r: tx.ranked_score(F.lit(98.0), tx.role_adjust(r)))
    assert got == [100.0, 99.0, 95.0, 98.0, 90.0, 95.0, 88.0, 93.0, 93.0, 98.0]
    assert column(spark, ["label"], lambda r: tx.ranked_score(F.lit(3.0), tx.role_adjust(r))) == [0.0]


def test_noise(spark):
    marks = [None, "", "  ", "\n", "#", ",", ".", "(", ")", "[", "]", ";", ":", "*", "&", "–", "-", " # "]
    assert column(spark, marks, tx.is_noise) == [True] * len(marks)
    assert column(spark, ["hello", "a", "##", "1"], tx.is_noise) == [False] * 4


def test_normalize_lines(spark):
    got = column(spark, ["  a \t b  \n\n\n  c", "", "x\r\ny", " z "], tx.normalize_lines)
    assert got == ["a b\nc", "", "x\ny", "z"]


def test_page_domain(spark):
    df = spark.createDataFrame(
        [("x/HIGH.html", ["HIGH"], "c"), ("x/low.html", ["HIGH"], "c"), ("x", None, None), ("x", [], "py")],
        "u string, g array<string>, d string",
    )
    got = [r[0] for r in df.select(tx.page_domain(F.col("u"), F.col("g"), F.col("d"))).collect()]
    assert got == ["cpp", "c", "", "py"]


def test_or_groups_are_json_stable(spark):
    got = column(spark, ["a b | c"], lambda q: F.to_json(tx.or_groups(q)))
    assert json.loads(got[0]) == [["a", "b"], ["c"]]
