"""The registry of documentation sources and lookups in it."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.urls import url_join
from docsift.operators.ranking import first_by
from docsift.operators.sizing import broadcast_if_small
from docsift.schemas import SOURCES

# --- fixed values -----------------------------------------------------------
DOC_TYPES = ["sphinx", "doxygen", "sphinx_noinv", "pdf"]
INVENTORY_FILE = "objects.inv"
INDEX_FILE = "genindex.html"
# ----------------------------------------------------------------------------


def load_registry(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame | str:
    """The registry table, or a message where it is missing, malformed or unreadable."""
    try:
        reader = spark.read.schema(SOURCES)
        if fmt == "json":
            reader = reader.option("mode", "FAILFAST")
        registry = reader.format(fmt).load(path)
        # Malformed rows only show when they are read; one aggregate reads them all.
        registry.agg(F.count(F.to_json(F.struct("*")))).first()
        return registry
    except (PySparkException, Py4JJavaError) as error:
        text = str(error)
        if "PATH_NOT_FOUND" in text:
            return f"registry not found: {path}"
        malformed = re.search(r"\[MALFORMED[^\n]*", text)
        if malformed:
            return f"failed to parse registry {path}: {malformed[0]}"
        return f"failed to read registry {path}: {text.splitlines()[0]}"


def _missing(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def validate_sources(sources: DataFrame) -> DataFrame:
    """One row per broken rule: (source_ord, name, violation)."""
    known = F.col("doc_type").isin(DOC_TYPES)
    no_entry = (F.coalesce(F.size("inventory_urls"), F.lit(0)) <= 0) & _missing(F.col("index_url"))
    is_pdf = F.coalesce(F.col("doc_type") == "pdf", F.lit(False))
    rules = [
        (_missing(F.col("name")), "name is required"),
        (_missing(F.col("doc_type")), "doc_type is required"),
        (~_missing(F.col("doc_type")) & ~known, "doc_type is not supported"),
        (~is_pdf & no_entry, "inventory_urls or index_url is required"),
        (is_pdf & _missing(F.col("doc_url")), "doc_url is required for pdf"),
    ]
    broken = F.array(*[F.when(rule, F.lit(text)) for rule, text in rules])
    return sources.select(
        "source_ord",
        "name",
        F.explode(F.filter(broken, lambda v: v.isNotNull())).alias("violation"),
    )


def list_sources(sources: DataFrame) -> DataFrame:
    """Name, type, description and tags of every source, sorted by name."""
    empty = F.array().cast("array<string>")
    return sources.orderBy(F.coalesce("name", F.lit("")), "source_ord").select(
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("doc_type", F.lit("")).alias("doc_type"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("tags", empty).alias("tags"),
    )


_RESOLVED = ["match_threshold", "doc_type", "doc_url", "index_url"]


def _lookup(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Every request with the source it names, or NULL.

    Aliases are reduced to one source each before the join, so a tag carried by
    many sources does not multiply rows.
    """
    fields = F.struct(F.col("name").alias("source"), "source_ord", *_RESOLVED)
    named = sources.filter(F.col("name").isNotNull()).withColumn("_source", fields)
    tagged = named.withColumn("_tag", F.explode("tags"))
    first = F.min_by("_source", "source_ord")
    by_name = named.groupBy(F.col("name").alias("requested")).agg(first.alias("_by_name"))
    by_tag = tagged.groupBy(F.lower("_tag").alias("_lowered")).agg(first.alias("_by_tag"))
    return (
        requests.withColumn("_lowered", F.lower("requested"))
        .join(by_name, "requested", "left")
        .join(by_tag, "_lowered", "left")
        .withColumn("_source", F.coalesce("_by_name", "_by_tag"))
        .select("query_id", "request_ord", "requested", "_source.*")
    )


def resolve_requests(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests with the source each one names; unknown ones are left out.

    An exact name wins over an equal tag (any case); among equals the first
    source in registry order wins.
    """
    return _lookup(requests, sources).filter(F.col("source").isNotNull())


def unknown_sources(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests that name no source."""
    unknown = _lookup(requests, sources).filter(F.col("source").isNull())
    return unknown.select("query_id", "request_ord", "requested")


def canonical_requests(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Resolved requests, each source once per query under the first name asked for.

    A query with an unknown source fails as a whole and has no rows.
    """
    found = _lookup(requests, sources)
    failed = found.filter(F.col("source").isNull()).select("query_id").distinct()
    known = found.filter(F.col("source").isNotNull())
    return first_by(known, ["query_id", "source"], ["request_ord"]).join(failed, "query_id", "left_anti")


def latest_fetch(crawl_log: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Newest log row of every URL, or of the URLs in ``urls`` (url).

    Few URLs of a long log matter to a registry: while they measure small they
    are broadcast, and only their rows are shuffled.
    """
    rows = crawl_log.select("url", "status", "final_url", "content_type", "error", "fetched_at")
    if urls is not None:
        wanted, _ = broadcast_if_small(urls.filter(F.col("url").isNotNull()).select("url").distinct())
        rows = rows.join(wanted, "url", "left_semi")
    return first_by(rows, ["url"], ["fetched_at", "status", "final_url", "content_type", "error"], last=True)


def first_reachable(sources: DataFrame, crawl_log: DataFrame) -> DataFrame:
    """(source, inventory_url): the first inventory that answers, after redirects.

    Tried in order: the override, the listed inventories, then the inventory
    beside the final address of every base URL.
    """
    empty = F.array().cast("array<string>")
    urls = lambda name: F.coalesce(F.col(name), empty)
    tagged = lambda values, is_base: F.transform(
        values, lambda u: F.struct(F.lit(is_base).alias("is_base"), u.alias("url"))
    )
    override = F.when(F.col("override_url").isNotNull(), F.array("override_url")).otherwise(empty)
    tries = sources.select(
        F.col("name").alias("source"),
        F.posexplode(
            F.concat(
                tagged(override, False),
                tagged(urls("inventory_urls"), False),
                tagged(urls("base_urls"), True),
            )
        ).alias("priority", "_try"),
    ).select("source", "priority", "_try.*")

    def answered(wanted: DataFrame) -> DataFrame:
        alive = latest_fetch(crawl_log, wanted).filter(F.col("status") < 400)
        return wanted.join(alive.select("url", F.coalesce("final_url", "url").alias("_final")), "url")

    first = answered(tries)
    derived = first.filter("is_base").select(
        "source", "priority", url_join(F.col("_final"), F.lit(INVENTORY_FILE)).alias("url")
    )
    hits = first.filter(~F.col("is_base")).select("source", "priority", "_final")
    return (
        hits.unionByName(answered(derived).select("source", "priority", "_final"))
        .groupBy("source")
        .agg(F.min_by("_final", "priority").alias("inventory_url"))
    )


def index_page_url(index_url: Column) -> Column:
    return F.concat(F.rtrim(index_url, F.lit("/")), F.lit("/" + INDEX_FILE))


def source_status(sources: DataFrame, reachable: DataFrame, indexed: DataFrame, broken: DataFrame) -> DataFrame:
    """Why a source cannot be searched, and where to read it instead.

    ``reachable`` has (source, inventory_url), ``indexed`` the sources with index
    entries (before any domain filter), ``broken`` those with malformed links.
    """
    kind = F.col("doc_type")
    reason = (
        F.when(F.col("_broken"), "fetch error")
        .when((kind == "sphinx") & F.col("inventory_url").isNull(), "no inventory")
        .when((kind == "sphinx_noinv") & F.col("_indexed").isNull(), "no genindex")
        .when(kind == "pdf", "pdf")
        .when(
            kind.isNull() | ~kind.isin(DOC_TYPES),
            F.concat(F.lit("unsupported doc_type: "), F.coalesce(kind, F.lit("None"))),
        )
    )
    index_url = F.coalesce("index_url", F.lit(""))
    doc_url = F.when(F.col("skipped_reason") == "no genindex", index_url).when(
        F.col("skipped_reason") == "pdf", F.when(_missing(F.col("doc_url")), index_url).otherwise(F.col("doc_url"))
    )
    return (
        sources.withColumnRenamed("name", "source")
        .join(reachable, "source", "left")
        .join(indexed.select("source").distinct().withColumn("_indexed", F.lit(True)), "source", "left")
        .join(broken.select("source").distinct().withColumn("_broken", F.lit(True)), "source", "left")
        .withColumn("skipped_reason", reason)
        .select("source", "source_ord", "doc_type", "inventory_url", "skipped_reason", doc_url.alias("doc_url"))
    )


def with_warning(status: DataFrame) -> DataFrame:
    """Add the text that tells a user why the requested source was skipped."""
    quoted = F.concat(F.lit("'"), F.col("requested"), F.lit("'"))
    reason, kind = F.col("skipped_reason"), F.coalesce("doc_type", F.lit("None"))
    text = (
        F.when(reason == "no inventory", F.concat(quoted, F.lit(": no valid objects.inv found, skipping")))
        .when(
            reason == "no genindex",
            F.concat(quoted, F.lit(" ("), kind, F.lit("): no genindex available, skipping")),
        )
        .when(reason == "pdf", F.concat(quoted, F.lit(" (pdf) does not support symbol search, skipping")))
        .when(
            reason.startswith("unsupported"),
            F.concat(quoted, F.lit(": unsupported doc_type '"), kind, F.lit("', skipping")),
        )
        .when(reason == "fetch error", F.concat(quoted, F.lit(": fetch failed (malformed link), skipping")))
    )
    return status.withColumn("warning", text)


def skipped_sources(status: DataFrame) -> DataFrame:
    """Per query the map requested name -> documentation URL of the skipped sources that have one."""
    entries = F.array_sort(F.collect_list(F.struct("request_ord", "requested", "doc_url")))
    shown = status.filter(F.col("skipped_reason").isNotNull() & ~_missing(F.col("doc_url")))
    return shown.groupBy("query_id").agg(
        F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["requested"], e["doc_url"]))
        ).alias("skipped_sources")
    )
