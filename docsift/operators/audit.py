"""Health checks of documentation sources, computed from a crawl log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.sources.registry import DOC_TYPES, INVENTORY_FILE, latest_fetch

# --- fixed values -----------------------------------------------------------
DETAIL_WIDTH = 60
# ----------------------------------------------------------------------------

_CHECK = ["check", "ok", "detail"]


def url_health(crawl_log: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Newest state of every URL, or of those in ``urls`` (url); only status 200 is healthy."""
    answered = F.col("error").isNull() & F.col("status").isNotNull()
    return latest_fetch(crawl_log, urls).select(
        "url",
        F.when(answered, F.col("status")).alias("status"),
        (answered & (F.col("status") == 200)).alias("ok"),
        F.when(answered & (F.col("final_url") != F.col("url")), F.col("final_url")).alias("redirected_to"),
        F.when(answered, F.coalesce("content_type", F.lit(""))).otherwise("").alias("content_type"),
        F.when(~answered, F.coalesce("error", F.lit("no response"))).alias("error"),
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _check(name: str, ok: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail")
    )


def _missing(url: Column) -> Column:
    return F.coalesce(url, F.lit("")) == ""


def _outcome() -> Column:
    return F.coalesce(F.col("status").cast("string"), F.col("error"), F.lit("not in crawl log"))


def _redirect() -> Column:
    return F.coalesce(_text(" (redirected to ", F.col("redirected_to"), ")"), F.lit(""))


def _healthy() -> Column:
    return F.coalesce(F.col("ok"), F.lit(False))


def _inventory_candidates() -> Column:
    """The listed inventories, then those beside the base URLs that are not listed."""
    empty = F.array().cast("array<string>")
    listed = F.coalesce("inventory_urls", empty)
    beside = F.transform(
        F.coalesce("base_urls", empty), lambda b: _text(F.rtrim(b, F.lit("/")), "/" + INVENTORY_FILE)
    )
    return F.concat(listed, F.array_except(beside, listed))


def audited_urls(sources: DataFrame) -> DataFrame:
    """Every address an audit of these sources looks up."""
    return sources.select(
        F.explode(F.concat(_inventory_candidates(), F.array("index_url", "doc_url"))).alias("url")
    ).filter(F.col("url").isNotNull())


def inventory_checks(sources: DataFrame, health: DataFrame, counts: DataFrame) -> DataFrame:
    """Checks of inventory sources: candidates in order up to the first that answers with objects.

    ``counts`` has (url, total, domains) by final inventory URL.
    """
    own = sources.select("source_ord", _inventory_candidates().alias("_urls"))

    tries = own.select("source_ord", F.posexplode("_urls").alias("at", "url")).join(health, "url", "left")
    tries = tries.withColumn("_final", F.coalesce("redirected_to", "url")).join(
        counts.withColumnRenamed("url", "_final"), "_final", "left"
    )
    total = F.coalesce("total", F.lit(0))
    success = _healthy() & (total > 0)
    # The candidates of one source are a short configured list.
    before = Window.partitionBy("source_ord").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    reached = tries.withColumn("_done", F.coalesce(F.max(success).over(before), F.lit(False))).filter("not _done")

    found = _check("inventory_url", F.lit(True), _text(F.col("url"), _redirect()))
    parsed = _check(
        "inventory_parse",
        total > 0,
        _text(total.cast("string"), " objects, domains: ", F.coalesce("domains", F.lit("{}"))),
    )
    failed = _check("inventory_url", F.lit(False), _text(F.col("url"), " -> ", _outcome()))
    attempts = reached.select(
        "source_ord",
        "at",
        F.posexplode(F.when(_healthy(), F.array(found, parsed)).otherwise(F.array(failed))).alias("step", "_c"),
    ).select("source_ord", (F.col("at") * 2 + F.col("step")).alias("check_ord"), "_c.*")
    nothing = _check("inventory_urls", F.lit(False), F.lit("no inventory_urls or base_urls defined"))
    unset = (
        own.filter(F.size("_urls") == 0)
        .select("source_ord", F.lit(0).alias("check_ord"), nothing.alias("_c"))
        .select("source_ord", "check_ord", "_c.*")
    )
    return attempts.unionByName(unset)


def _page_checks(sources: DataFrame, field: str, health: DataFrame, checks: Column) -> DataFrame:
    """Checks of sources with one address; ``checks`` is used where it is set."""
    unset = F.array(_check(field, F.lit(False), F.lit(f"no {field} defined")))
    return (
        sources.withColumnRenamed(field, "url")
        .join(health, "url", "left")
        .select("source_ord", F.posexplode(F.when(_missing(F.col("url")), unset).otherwise(checks)).alias("check_ord", "_c"))
        .select("source_ord", "check_ord", "_c.*")
    )


def index_checks(sources: DataFrame, health: DataFrame, link_counts: DataFrame) -> DataFrame:
    """Checks of sources with an index of group links; ``link_counts`` has (url, n_links) by final URL."""
    links = F.coalesce("n_links", F.lit(0))
    with_links = health.withColumn("_final", F.coalesce("redirected_to", "url")).join(
        link_counts.withColumnRenamed("url", "_final"), "_final", "left"
    )
    answer = _check("index_url", _healthy(), _text(F.col("url"), " -> ", _outcome(), _redirect()))
    found = _check("group_links", links > 0, _text(links.cast("string"), " group__ links found"))
    checks = F.when(_healthy(), F.array(answer, found)).otherwise(F.array(answer))
    return _page_checks(sources, "index_url", with_links, checks)


def pdf_checks(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Checks of PDF sources: an HTML answer is not a PDF."""
    is_html = _healthy() & F.contains(F.lower("content_type"), F.lit("text/html"))
    kind = F.when(_missing(F.col("content_type")), "unknown").otherwise(F.col("content_type"))
    detail = (
        F.when(
            F.col("status").isNull(),
            _text("HEAD ", F.col("url"), " failed: ", F.coalesce("error", F.lit("not in crawl log"))),
        )
        .when(
            is_html,
            _text(
                F.col("url"),
                " -> 200 but Content-Type is ",
                F.col("content_type"),
                " (expected PDF, not HTML)",
                _redirect(),
            ),
        )
        .otherwise(_text(F.col("url"), " -> ", F.col("status").cast("string"), ", Content-Type: ", kind, _redirect()))
    )
    return _page_checks(sources, "doc_url", health, F.array(_check("doc_url", _healthy() & ~is_html, detail)))


def page_checks(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Checks of sources that are browsed by hand."""
    answer = _check("index_url", _healthy(), _text(F.col("url"), " -> ", _outcome(), _redirect()))
    return _page_checks(sources, "index_url", health, F.array(answer))


def config_checks(sources: DataFrame) -> DataFrame:
    """One failing check per source of an unknown type."""
    kind = F.coalesce("doc_type", F.lit("unknown"))
    odd = sources.filter(F.col("doc_type").isNull() | ~F.col("doc_type").isin(DOC_TYPES))
    check = _check("doc_type", F.lit(False), _text("unsupported doc_type: ", kind))
    return odd.select("source_ord", F.lit(0).alias("check_ord"), check.alias("_c")).select(
        "source_ord", "check_ord", "_c.*"
    )


def all_checks(
    sources: DataFrame, crawl_log: DataFrame, counts: DataFrame, link_counts: DataFrame
) -> DataFrame:
    """(source_ord, check_ord, check, ok, detail) of every source, by its type."""
    health = url_health(crawl_log, audited_urls(sources))
    of = lambda kind: sources.filter(F.col("doc_type") == kind)
    parts = [
        inventory_checks(of("sphinx"), health, counts),
        index_checks(of("doxygen"), health, link_counts),
        pdf_checks(of("pdf"), health),
        page_checks(of("sphinx_noinv"), health),
        config_checks(sources),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def roll_up(sources: DataFrame, checks: DataFrame, only: str | None = None) -> DataFrame:
    """Per source its verdict and its checks in order; ``only`` keeps sources of that exact name.

    A source with inventories passes if one of them is good, any other if all
    its checks pass.
    """
    entries = F.array_sort(F.collect_list(F.struct("check_ord", *_CHECK)))
    per_source = checks.groupBy("source_ord").agg(
        F.transform(entries, lambda c: F.struct(c["check"], c["ok"], c["detail"])).alias("checks"),
        F.every("ok").alias("_all"),
        F.bool_or((F.col("check") == "inventory_parse") & F.col("ok")).alias("_inventory"),
    )
    wanted = sources if only is None else sources.filter(F.col("name") == only)
    verdict = F.when(F.col("doc_type") == "sphinx", F.col("_inventory")).otherwise(F.col("_all"))
    return wanted.select("source_ord", "name", "doc_type").join(per_source, "source_ord").select(
        "source_ord",
        F.coalesce("name", F.lit("unknown")).alias("name"),
        verdict.alias("ok"),
        F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"),
        "checks",
    )


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("ok").alias("passed"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def headline(results: DataFrame) -> DataFrame:
    """One line per source: the last passing check, or the first failing one with its name."""
    last = F.try_element_at("checks", F.lit(-1))["detail"]
    passing = F.try_element_at(F.filter("checks", lambda c: c["ok"]), F.lit(-1))["detail"]
    failing = F.try_element_at(F.filter("checks", lambda c: ~c["ok"]), F.lit(1))
    shown = F.when(F.col("ok"), passing).otherwise(
        F.concat(failing["check"], F.lit(": "), failing["detail"])
    )
    detail = F.coalesce(F.when(shown != "", shown), last, F.lit(""))
    short = F.when(
        F.length(detail) > DETAIL_WIDTH, F.concat(F.left(detail, F.lit(DETAIL_WIDTH - 3)), F.lit("..."))
    ).otherwise(detail)
    status = F.when(F.col("ok"), "OK").otherwise("FAIL")
    return results.select("source_ord", "name", "doc_type", status.alias("status"), short.alias("detail"))
