"""URL filters over host-suffix and path-prefix expressions (operator 4).

Every distinct (host, path) is expanded into the expressions a rule could be written as: the last labels of its host
with a beginning of its path. Only shapes that occur among the rules (labels of the host, length of the path) are
expanded, so their number does not depend on the length of a url. Expressions and rules meet in an equi-join on the
first 8 hex digits of SHA-256; whole digests confirm, and of the confirmed rules the longest expression wins (between
equal lengths the longer host; between equal expressions, block).

The rules are a table; its rows are joined, and broadcast only if Spark finds them small. The shapes are collected: one
small row for each combination that the rules use. Urls that are null or have no ``://`` have an empty host and path and
fit no rule, and repeated rows are judged alike. Rules with a null host or path are ignored; an empty rule table allows
everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 8  # hex digits of the digest that the join uses


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (replacing columns of these names).

    ``rules``: ``host``, ``path``, ``verdict`` (allow or block).
    """
    kept = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else pages
    pages = kept.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rules = rules.filter("host is not null and path is not null").select(
        F.concat("host", F.lit("\n"), "path").alias("r_expr"),
        F.concat("host", "path").alias("r_rule"),
        F.length("host").alias("r_host_length"),
        F.col("verdict").alias("r_verdict"),
        _labels(F.col("host")).alias("r_labels"),
        F.length("path").alias("r_path_length"),
    )
    shapes = rules.select("r_labels", "r_path_length").distinct().collect()
    rules = (
        rules.groupBy("r_expr")
        .agg(*(F.max(c).alias(c) for c in ("r_rule", "r_host_length", "r_verdict")))
        .withColumn("r_digest", F.sha2("r_expr", 256))
        .withColumn("r_short", F.substring("r_digest", 1, SHORT))
    )
    labels = F.split("host", r"\.")
    expressions = [
        F.when(
            (F.size(labels) >= n) & (F.length("path") >= m),
            F.concat(F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), "."), F.lit("\n"), F.substring("path", 1, m)),
        )
        for n, m in shapes
    ]
    targets = pages.select("host", "path").filter("host != '' or path != ''").distinct()
    every = F.array_compact(F.array(*expressions)) if expressions else F.array().cast("array<string>")
    probes = targets.withColumn("expr", F.explode(every)).withColumn("digest", F.sha2("expr", 256))
    found = probes.join(rules, (F.substring("digest", 1, SHORT) == F.col("r_short")) & (F.col("digest") == F.col("r_digest")))
    best = found.groupBy("host", "path").agg(
        F.max(F.struct(F.length("r_rule"), "r_host_length", "r_verdict", "r_rule")).alias("_best")
    )
    judged = pages.join(best, ["host", "path"], "left")
    verdict = F.coalesce(F.col("_best.r_verdict"), F.lit(default))
    return judged.withColumns({"rule": F.col("_best.r_rule"), "verdict": verdict}).select(
        *kept.columns, *(c for c in ("host", "path") if c not in kept.columns), "rule", "verdict"
    )
