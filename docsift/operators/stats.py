"""Counts over the symbol relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions import text as tx


def domain_stats(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Symbols per source and domain with their rank and the source's total.

    Most frequent first, ties in order of first appearance.  Group links do not
    count; sources that publish neither an inventory nor members have no rows.
    """
    supported = sources.filter(F.col("doc_type").isin("sphinx", "doxygen")).select(F.col("name").alias("source"))
    per_domain = (
        symbols.filter(F.col("kind") != "group")
        .groupBy("source", F.coalesce("domain", F.lit("")).alias("domain"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
        .join(supported, "source", "left_semi")
    )
    order = Window.partitionBy("source").orderBy(F.desc("n"), "first")
    total = F.sum("n").over(Window.partitionBy("source"))
    return per_domain.select(
        "source", "domain", "n", F.row_number().over(order).alias("rank"), total.alias("total")
    )


def total_found(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """Symbols of every (query, source) after the domain filter; 0 for a source without any.

    The catalog is reduced to one row per source and domain before it meets the
    queries.
    """
    histogram = symbols.groupBy("source", "domain", (F.col("kind") == "group").alias("_exempt")).agg(
        F.count(F.lit(1)).alias("n")
    )
    kind = F.when(F.col("_exempt"), "group").otherwise("other")
    counted = F.when(tx.in_domains(kind, F.col("domain"), F.col("wanted")), F.col("n"))
    return (
        targets.select("query_id", "source", "requested", "request_ord", "wanted")
        .join(histogram, "source", "left")
        .groupBy("query_id", "requested", "request_ord")
        .agg(F.coalesce(F.sum(counted), F.lit(0)).alias("total_found"))
    )
