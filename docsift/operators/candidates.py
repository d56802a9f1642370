"""Term x name candidates as one equi-join on shared tokens.

Names and terms are cut into tokens such that every pair that can reach its
threshold shares at least one; pairs without a common token are never formed.
The join only proposes pairs, the score decides.

* ``g``: substrings of fixed sizes.  A term contained in a name shares its own
  last gram with it.
* ``p``: two characters at most 3 apart, with a distance budget.  At a
  threshold of 60 or more a term of 3+ characters needs two consecutive matched
  characters whose distances in both strings sum to at most 4: with L matched
  characters the L - 1 gaps sum to at most (m - 1) + (w - 1), and
  L >= 0.3 (m + w) leaves one pair of gaps with a sum of 4 or less.
* ``c`` / ``s``: single characters, for terms / names of one or two characters,
  where one matched character can be enough, and for thresholds under 60.
* ``*``: everything, only for thresholds of 0 or less, which every pair passes.

``may_reach`` then bounds the similarity of a pair from its character counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import SIMILARITY_CAP

GRAM_SIZES = [1, 2, 3, 6]
PAIR_BUDGET = 4
PAIR_MIN_THRESHOLD = 60.0
_SHORT = 2


def _chars(text: Column) -> Column:
    return F.array_distinct(F.transform(_positions(text, 1), lambda i: F.substr(text, i, F.lit(1))))


def _positions(text: Column, size: int) -> Column:
    """1-based starts of the substrings of one size, empty for shorter texts."""
    last = F.length(text) - (size - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _grams(text: Column, size: int) -> Column:
    return F.transform(
        _positions(text, size), lambda i: F.concat(F.lit(f"g{size}"), F.substr(text, i, F.lit(size)))
    )


def _tagged(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v))


def _pairs(text: Column, distance: int, budget: int) -> Column:
    return F.transform(
        _positions(text, distance + 1),
        lambda i: F.concat(
            F.lit(f"p{budget}"), F.substr(text, i, F.lit(1)), F.substr(text, i + distance, F.lit(1))
        ),
    )


def name_tokens(name: Column, gram_sizes: list[int], similarity: bool, everything: bool) -> Column:
    parts = [_grams(name, size) for size in gram_sizes]
    if similarity:
        reach = PAIR_BUDGET - 1
        parts += [_pairs(name, d, k) for d in range(1, reach + 1) for k in range(d, reach + 1)]
        parts.append(_tagged("c", _chars(name)))
        parts.append(F.when(F.length(name) <= _SHORT, _tagged("s", _chars(name))).otherwise(F.array()))
    if everything:
        parts.append(F.array(F.lit("*")))
    return F.array_distinct(F.concat(*parts))


def gram_size(term: Column) -> Column:
    size = F.lit(GRAM_SIZES[0])
    for g in GRAM_SIZES[1:]:
        size = F.when(F.length(term) >= g, g).otherwise(size)
    return size


def term_tokens(term: Column, threshold: Column) -> Column:
    size = gram_size(term)
    gram = F.concat(F.lit("g"), size.cast("string"), F.right(term, size))
    pairs = F.concat(*[_pairs(term, d, PAIR_BUDGET - d) for d in range(1, PAIR_BUDGET)])
    close = F.concat(
        F.array(gram),
        pairs,
        _tagged("s", _chars(term)),
        F.when(F.length(term) <= _SHORT, _tagged("c", _chars(term))).otherwise(F.array()),
    )
    return F.array_distinct(
        F.when(threshold > SIMILARITY_CAP, F.array(gram))
        .when(threshold >= PAIR_MIN_THRESHOLD, close)
        .when(threshold > 0, F.concat(F.array(gram), _tagged("c", _chars(term))))
        .otherwise(F.array(F.lit("*")))
    )


def may_reach(term: Column, name: Column, threshold: Column) -> Column:
    """Whether the similarity of a pair can reach the threshold, judged by the characters they have in common.

    A window of w characters that matches L of them has 200 L / (m + w), m being the shorter length.  L is at most w and
    at most C, the common characters counted with repetition, so that no window exceeds 200 C / (m + C).
    """
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(_chars(term), F.lit(0), lambda n, c: n + F.least(count(term, c), count(name, c)))
    shorter = F.least(F.length(term), F.length(name))
    return F.lit(200.0) * common + F.lit(1e-6) >= threshold * (shorter + common)


def salts(spark: SparkSession) -> int:
    """In how many parts a hot key is cut: one for each task that can run at once."""
    return max(2, spark.sparkContext.defaultParallelism)


def candidate_pairs(
    names: DataFrame, key: str, lowered: Column, terms: DataFrame, gram_sizes: list[int], lowest: float, small: bool
) -> DataFrame:
    """Distinct (key, term, threshold): the different names with the terms (``term``, ``threshold``) they may match.

    ``names`` has one row per ``key``; partitioned by it, the pairs lose their duplicates without another shuffle.
    ``gram_sizes`` and ``lowest`` (threshold) describe the terms and spare tokens none of them has.  While the term side
    is ``small``, names stream past a broadcast copy.  Otherwise both sides shuffle on (token, salt), so that a token
    found in most names is spread over many tasks.
    """
    tokens = name_tokens(lowered, gram_sizes or GRAM_SIZES[:1], lowest <= SIMILARITY_CAP, lowest <= 0)
    term_side = terms.withColumn("_token", F.explode(term_tokens(F.col("term"), F.col("threshold"))))
    # explode_outer: the plain form makes Spark add a filter that computes the tokens twice.
    if small:
        pairs = names.select(key, F.explode_outer(tokens).alias("_token")).join(F.broadcast(term_side), "_token")
    else:
        n = salts(names.sparkSession)
        narrow = names.select(
            key, F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("_salt"), F.explode_outer(tokens).alias("_token")
        )
        salted = term_side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        pairs = narrow.join(salted, ["_token", "_salt"])
    return pairs.select(key, "term", "threshold").distinct()
