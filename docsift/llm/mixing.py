"""Mixing sources to target weights (operator 8).

Sizes (words) are summed by source. Sources in code point order, null last, have the weights 5, 2, 1, repeating; their
targets share the sum of all sizes by weight, stop at 3 times a source's size, and what is over is shared again by
weight until no target is above its stop: target = min(weight * level, 3 * size) with the one level at which the
targets add up. The level follows from running sums over the sources in order of 3 * size / weight.

A document is emitted floor(rate) times, rate = target / size of its source, and once more with probability
rate - floor(rate). The coin is a digest of the seed and ``doc_id``, so every rerun agrees, and rows that repeat a
``doc_id`` and text are treated alike. Tables of sources have one row for each source; documents are only joined to it,
by a broadcast while it has at most ``MOST_SOURCES`` rows, so that texts stay where they are, and by a shuffle beyond.
A null text has size 0; a null ``doc_id`` has one coin; columns of any other name are kept; a source of size 0 has target 0 and its documents, being empty, are emitted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.storage import cut

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
MOST_SOURCES = 20_000
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def n_words(text: Column) -> Column:
    """Number of words: places where a word begins. Texts stay whole; nothing is exploded."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone (52 bits of MD5)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each source: ``source``, ``source_size``, ``target``."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (place + 1).cast("int"))
    full = F.col("source_size") * most / F.col("weight")
    order = [full, F.col("source").asc_nulls_last()]
    up_to = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = (
        sums.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("stops_before", F.sum(F.col("source_size") * most).over(up_to) - F.col("source_size") * most)
        .withColumn("weights_before", F.sum("weight").over(up_to) - F.col("weight"))
    )
    # the level if this source and all after it stay below their stops; the first source for which that holds gives it
    level = (F.col("total") - F.col("stops_before")) / (F.col("weights") - F.col("weights_before"))
    stays = running.withColumn("level", level).withColumn("below", full >= F.col("level"))
    first = F.min(F.when(F.col("below"), F.struct(full.alias("full"), F.col("source").isNull().alias("last"), "source", "level"))).over(whole)
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.col("first.level"))
    return stays.withColumn("first", first).select("source", "source_size", target.alias("target"))


def mix_rates(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies`` (replacing columns of these names)."""
    own = [c for c in docs.columns if c not in ADDED]
    slim = docs.select("source", n_words(F.col("text")).alias("size"))
    goal = cut(targets(slim, weights, most).toDF("g_source", "g_size", "g_target"))
    if goal.count() <= MOST_SOURCES:
        goal = F.broadcast(goal)
    rate = F.when(F.col("g_size") > 0, F.col("g_target") / F.col("g_size")).otherwise(1.0)
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("d"))  # so that no name of the caller meets ours
    joined = named.join(goal, F.col("d.source").eqNullSafe(F.col("g_source")), "left")
    whole = F.floor(rate)
    copies = whole + (coin(F.col("d.doc_id"), seed) < rate - whole).cast("long")
    added = (n_words(F.col("d.text")), F.col("g_size"), F.col("g_target"), copies)
    return joined.select(*(F.col("d").getField(c).alias(c) for c in own), *(c.alias(name) for c, name in zip(added, ADDED, strict=True)))


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed rows: each document as often as it is emitted, with ``copy`` = 1, 2, ... (replacing a column ``copy``)."""
    own = [c for c in docs.columns if c != "copy"]
    named = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in own)).alias("all"))
    rated = mix_rates(named, seed, weights, most).filter("mix_copies > 0")
    rows = rated.select("all", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies")).alias("copy"))
    return rows.select(*(F.col("all").getField(c).alias(c) for c in own), "copy")
