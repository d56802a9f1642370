"""The whole query batch where registered queries, tied to their SQL, take a part of it."""

from pathlib import Path

import duckdb
import pytest

import check
from docsift import adaptors as ad
from docsift.plans import export
from docsift.plans.search import search_and_count, search_batch
from pyspark.sql import functions as F
from workloads import oracles
from workloads.queries import _scored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="benchmark tables not present")


def by_sql(sql):
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def test_every_shape_below_the_threshold_of_60(spark):
    queries = ad.query_batch(spark, SF).withColumn("threshold", F.lit(50.0))
    own = _scored(search_batch(ad.symbols_part(spark, SF), ad.catalog_sources(spark, SF), queries, ad.batch_requests(queries)))
    columns, rows = by_sql(oracles.batch("50.0", "CASE WHEN w1 = 'cold' THEN 7 END") + oracles.BATCH_ROWS)
    assert check.rows_of(own.columns, own.collect()) == check.rows_of(columns, rows)
    assert {r[columns.index("query_id")].split("-")[0] for r in rows} >= {"and", "or", "typo", "bool"}


def test_export_without_a_limit(spark):
    limited = oracles.batch("88.0", "4", "true", "(request_ord = 0 OR query_id NOT LIKE '%bolt')")
    whole = oracles.batch("88.0", "NULL", "true", "(request_ord = 0 OR query_id NOT LIKE '%bolt')")
    registered = oracles.ORACLES["export_json_envelope"]
    assert registered.startswith(limited)
    columns, rows = by_sql(whole + registered[len(limited) :])
    queries = ad.query_batch(spark, SF).withColumns({"threshold": F.lit(88.0), "max_results": F.lit(None).cast("int")})
    requests = ad.batch_requests(queries).filter("request_ord = 0 or query_id not like '%bolt'")
    found, counts = search_and_count(ad.symbols_part(spark, SF), ad.catalog_sources(spark, SF), queries, requests)
    lines = export.json_lines(found, counts, queries)
    assert check.rows_of(lines.columns, lines.collect()) == check.rows_of(columns, rows)
    assert max(r[columns.index("rank")] for r in rows) > 4
