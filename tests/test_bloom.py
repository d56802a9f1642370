"""Bloom filters: nothing that was put in is lost, little else passes, and Spark and numpy agree."""

from __future__ import annotations

import numpy as np
from docsift.operators import bloom
from docsift.sources import pages as pg
from pyspark.sql import functions as F


def test_filters_in_spark_and_numpy(spark):
    n = 60_000  # more than one segment
    rows = spark.range(2 * n).select("id", F.xxhash64("id").alias("h"))
    inside = rows.filter(F.col("id") < n).select(F.when(F.col("id") % 1000 == 1, None).otherwise(F.col("h")).alias("h"))
    table = bloom.build(inside, "h", n)
    assert table.shape == (bloom.segments_for(n), bloom.SEGMENT_BITS // 8) and len(table) > 1
    every = rows.orderBy("id").toArrow()
    found = bloom.contains(table, every.column("h").to_numpy())
    known = np.arange(n) % 1000 != 1
    assert found[:n][known].all() and found[n:].mean() < 0.02
    passed = bloom.probed(rows, F.col("h"), bloom.segments(inside, "h", n), n)
    assert passed.columns == ["id", "h"]
    assert {r.id for r in passed.collect()} == set(np.flatnonzero(found).tolist())


def test_a_filter_has_a_bound(spark, monkeypatch):
    assert bloom.segments_for(0) == 1 and bloom.segments_for(10**15) == bloom.MOST_SEGMENTS
    monkeypatch.setattr(bloom, "MOST_SEGMENTS", 1)
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    table = bloom.build(rows, "h", 20_000)
    assert len(table) == 1 and bloom.contains(table, rows.toArrow().column("h").to_numpy()).all()


def test_page_bodies_pass_the_filter_before_they_move(spark):
    pages = spark.range(4000).select(F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.lit("x"), 50).alias("html"))
    wanted = spark.range(0, 4000, 40).select(F.concat(F.lit("http://h/"), "id").alias("url"), (F.col("id") + 1).alias("n"))
    found = pg.scan_pages(wanted.union(wanted.limit(3)).union(spark.createDataFrame([(None, 5)], "url string, n long")), pages, max_bytes=0)
    assert found.count() == 103 and found.columns == ["url", "html", "n"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bits" in plan or "bits" in plan
    probe = bloom.probed(pages, F.xxhash64("url"), bloom.segments(wanted.select(F.xxhash64("url").alias("h")), "h", 100), 100)
    physical = probe._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in physical and "Python" not in physical.split("BroadcastExchange")[0]
    assert 100 <= probe.count() <= 160
