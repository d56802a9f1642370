"""One runnable query per operator over the benchmark tables.

Each entry takes (spark, sf_dir), reads whole tables and returns a DataFrame
whose column names equal those of its SQL counterpart in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift import adaptors as ad
from docsift.functions import text as tx
from docsift.functions.similarity import partial_ratio as partial_ratio_of
from docsift.functions.urls import plain_join, without_fragment
from docsift.operators import audit as au
from docsift.operators.search import (
    best_per_url as best_of,
    match_keywords,
    name_forms,
    query_targets,
    tier_of,
    with_similarity,
)
from docsift.operators import stats
from docsift.operators.storage import checkpoint_folder, stored
from docsift.operators.texttree import with_text_tree
from docsift.plans import export
from docsift.plans.gather import gather_symbols as gather
from docsift.plans.search import batch_targets, search, search_and_count, search_batch
from docsift.plans.search import search_counts as counts_of
from docsift.sources import inventory, pages as pg, registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _six(value: Column | str) -> Column:
    return F.round(value, 6)


def _scored(results: DataFrame) -> DataFrame:
    return results.withColumn("score", _six("score"))


# --- search -----------------------------------------------------------------


@register
def fuzzy_search_tiers(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    return _scored(search(symbols, sources, ["lib_2", "tag1", "lib_0"], "red widget | bolt | ECON", True, 83.0))


@register
def fuzzy_search_partial(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    return _scored(search(symbols, sources, ["lib_0", "lib_1"], "red wigdet | blot | Pormo", True, None))


@register
def fuzzy_search_batch(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    queries = ad.query_batch(spark, sf)
    return _scored(search_batch(symbols, sources, queries, ad.batch_requests(queries)))


@register
def boolean_search(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    found = search(symbols, sources, ["lib_1"], "RED widget | old", domains="cpp, py")
    return found.drop("score", "matched_keyword", "origin")


@register
def boolean_search_order(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    return search(symbols, sources, ["lib_2", "lib_0"], "gear | red").select("rank", "group", "url", "source")


@register
def best_per_url(spark, sf):
    symbols = ad.symbols_part(spark, sf)
    matched = match_keywords(symbols, [["red"], ["bolt"]], True, F.lit(83.0), similarity=False)
    best = best_of(matched.drop("source_ord", "kind", "origin"), ["source"], F.lit(True))
    return best.select("source", "url", "group", "score", "matched_keyword", "tie_pos")


@register
def multi_source_merge(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    found = search(symbols, sources, ["TAG0", "lib_2", "lib_0"], "gear", True, 90.0)
    return found.select("rank", "group", "url", "source", "score")


@register
def multi_source_concat(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    found = search(symbols, sources, ["lib_1", "lib_0"], None, True)
    return found.select("rank", "group", "url", "source")


@register
def topk_per_query(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    top = F.when(F.col("query_id").startswith("or"), 3).otherwise(5)
    queries = ad.query_batch(spark, sf).withColumns({"threshold": F.lit(88.0), "max_results": top})
    found = search_batch(symbols, sources, queries, ad.batch_requests(queries))
    return found.select("query_id", "rank", "group", "url", "source", "score")


@register
def search_counts(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    queries = ad.query_batch(spark, sf).withColumn("threshold", F.lit(90.0))
    return counts_of(symbols, sources, queries, ad.batch_requests(queries))


@register
def domain_stats(spark, sf):
    return stats.domain_stats(ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf))


@register
def query_parse(spark, sf):
    key = F.col("p_partkey")
    w1, w2 = ad.words()
    bar = F.lit("|")
    keywords = (
        F.when(key % 7 == 0, F.concat_ws(" ", w1, w2, bar, "p_type"))
        .when(key % 7 == 1, F.concat_ws(" ", bar, w1, bar, bar, w2, bar))
        .when(key % 7 == 2, F.concat(w1, bar, w2))
        .when(key % 7 == 3, F.lit(" | | "))
        .when(key % 7 == 4, F.concat(F.lit("  "), w1, F.lit(" \t "), w2, F.lit(" ")))
        .when(key % 7 == 5, F.concat(F.lit("||"), w1, F.lit(" |"), w2))
    )
    return ad.table(spark, sf, "part").select(
        "p_partkey",
        tx.has_keywords(keywords).alias("has_keywords"),
        F.to_json(tx.or_groups(keywords)).alias("or_groups"),
    )


def _odd_name() -> Column:
    key = F.col("p_partkey")
    camel = ad.camel_name()
    return (
        F.when(key % 4 == 0, camel)
        .when(key % 4 == 1, F.concat(F.lit("ns::"), F.lower("p_type"), F.lit("--"), F.initcap("p_name")))
        .when(key % 4 == 2, F.concat(F.lit("__XMLParser"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("HTTP2")))
        .otherwise(F.concat(camel, F.lit(" ( void* devPtr, "), "p_brand", F.lit(" )")))
    )


@register
def tokenize_names(spark, sf):
    return ad.table(spark, sf, "part").select(
        "p_partkey",
        F.to_json(tx.segments(_odd_name())).alias("segments"),
        tx.bare_name(_odd_name()).alias("bare_name"),
    )


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's name against terms from the next part: a word, a misspelt word, a long term, a short one."""
    parts = ad.table(spark, sf, "part")
    w1, w2 = ad.words()
    swapped = F.concat(F.left(w2, F.lit(1)), F.substr(w2, F.lit(3), F.lit(1)), F.substr(w2, F.lit(2), F.lit(1)), F.substr(w2, F.lit(4)))
    key = F.col("p_partkey")
    term = (
        F.when(key % 5 == 0, w1)
        .when(key % 5 == 1, swapped)
        .when(key % 5 == 2, F.concat("p_brand", "p_type", w1, w2, F.lit("Extended")))
        .when(key % 5 == 3, F.left(w2, F.lit(2)))
        .otherwise(F.concat(F.lower("p_type"), F.lit("_"), w1))
    )
    terms = parts.select((key - 1).alias("p_partkey"), F.lower(term).alias("term"))
    return parts.select("p_partkey", _odd_name().alias("group")).join(terms, "p_partkey")


@register
def term_score(spark, sf):
    pairs = name_forms(_pairs(spark, sf)).withColumn("tier", tx.pinned(tier_of(F.col("term"))))
    score = with_similarity(F.col("tier"), F.col("term"), F.lit(True))
    return pairs.select("p_partkey", "term", _six(score).alias("score"))


@register
def partial_ratio(spark, sf):
    pairs = _pairs(spark, sf)
    return pairs.select("p_partkey", _six(partial_ratio_of(F.col("term"), F.lower("group"))).alias("ratio"))


@register
def role_adjust(spark, sf):
    base = F.col("p_size") * 2.0
    role = ad._pick(F.col("p_partkey") % 10, [*ad.ROLES, None])
    return ad.table(spark, sf, "part").select(
        "p_partkey", tx.ranked_score(base, tx.role_adjust(role)).alias("ranked_score")
    )


@register
def threshold_resolve(spark, sf):
    key = F.substr("query_id", F.lit(2)).cast("long")
    requests = ad.customer_requests(spark, sf)
    queries = requests.filter("request_ord = 0").select(
        "query_id",
        F.lit("x").alias("keywords"),
        F.lit("all").alias("domains"),
        F.lit(True).alias("fuzzy"),
        F.when(key % 3 == 0, (key % 50).cast("double")).alias("threshold"),
        F.lit(None).cast("int").alias("max_results"),
    )
    resolved = registry.resolve_requests(requests, ad.registry_suppliers(spark, sf))
    return query_targets(queries, resolved).select("query_id", "request_ord", "source", "cut")


@register
def domain_filter(spark, sf):
    symbols = ad.symbols_part(spark, sf)
    asked = ad._pick(F.col("pos") % 7, ["all", "cpp, py", " ,c,", "", None, "ALL", "std ,nope"])
    kind = F.when(F.col("pos") % 11 == 0, "group").otherwise(F.col("kind"))
    rows = symbols.withColumns({"kind": kind, "asked": asked})
    kept = rows.filter(tx.in_domains(F.col("kind"), F.col("domain"), tx.domain_set(F.col("asked"))))
    return kept.select("pos", "group", "domain")


# --- registry ---------------------------------------------------------------


@register
def load_registry_file(spark, sf):
    path = f"{checkpoint_folder(spark)}/registry-{uuid4().hex}"
    ad.registry_suppliers(spark, sf).write.json(path)
    loaded = registry.load_registry(spark, path)
    return loaded.select("source_ord", "name", "doc_type", "index_url", "match_threshold", F.to_json("tags").alias("tags"))


@register
def list_sources(spark, sf):
    listed = registry.list_sources(ad.registry_suppliers(spark, sf))
    return listed.withColumn("tags", F.to_json("tags"))


@register
def validate_sources(spark, sf):
    return registry.validate_sources(ad.registry_suppliers(spark, sf))


@register
def resolve_alias(spark, sf):
    resolved = registry.resolve_requests(ad.customer_requests(spark, sf), ad.registry_suppliers(spark, sf))
    return resolved.select("query_id", "request_ord", "requested", "source")


@register
def unknown_sources(spark, sf):
    return registry.unknown_sources(ad.customer_requests(spark, sf), ad.registry_suppliers(spark, sf))


@register
def canonical_dedup(spark, sf):
    requests = ad.customer_requests(spark, sf).filter("requested <> 'nowhere'")
    chosen = registry.canonical_requests(requests, ad.registry_suppliers(spark, sf))
    return chosen.select("query_id", "request_ord", "requested", "source")


@register
def first_reachable(spark, sf):
    named = ad.registry_suppliers(spark, sf).filter("name is not null")
    return registry.first_reachable(named, ad.crawl_log_events(spark, sf))


def _customer_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status of the sources each customer asks for; every third index has entries."""
    sources = ad.registry_suppliers(spark, sf).filter("name is not null")
    reachable = registry.first_reachable(sources.filter("doc_type = 'sphinx'"), ad.crawl_log_events(spark, sf))
    name = sources.select(F.col("name").alias("source"), "source_ord")
    status = registry.source_status(
        sources, reachable, name.filter("source_ord % 9 < 3"), name.filter("source_ord % 13 = 12")
    ).drop("source_ord")
    requests = ad.customer_requests(spark, sf).filter("requested <> 'nowhere'")
    chosen = registry.canonical_requests(requests, sources).select("query_id", "request_ord", "requested", "source")
    return chosen.join(status, "source")


@register
def source_status(spark, sf):
    return registry.with_warning(_customer_status(spark, sf))


@register
def skipped_sources(spark, sf):
    skipped = registry.skipped_sources(_customer_status(spark, sf))
    return skipped.select("query_id", F.explode("skipped_sources").alias("requested", "doc_url"))


@register
def placeholder_rows(spark, sf):
    rows = export.placeholder_rows(_customer_status(spark, sf))
    return export.tsv_rows(rows).select("query_id", "request_ord", "line")


# --- extraction -------------------------------------------------------------


def _crawled_index(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("page_id")
    return ad.spread(ad.table(spark, sf, "pages").select("page_id", "url", "html")).select(
        F.concat(F.lit("site"), F.floor(page / 3)).alias("source"),
        page.cast("int").alias("source_ord"),
        F.col("url").alias("index_url"),
        "html",
    )


@register
def page_scan(spark, sf):
    pages = ad.table(spark, sf, "pages")
    failed = pages.select("page_id", "url", F.when(F.col("page_id") % 4 != 0, F.col("html")).alias("html"))
    wanted = pages.select("page_id", F.when(F.col("page_id") % 6 == 0, F.concat("url", F.lit("?gone"))).otherwise(F.col("url")).alias("url"))
    return pg.scan_pages(wanted, failed, version="page_id").select("page_id", "url", F.length("html").alias("size"))


@register
def page_scan_many(spark, sf):
    """The same where the wanted addresses are too many to broadcast: page bodies pass a Bloom filter before they move."""
    pages = ad.table(spark, sf, "pages")
    failed = pages.select("page_id", "url", F.when(F.col("page_id") % 4 != 0, F.col("html")).alias("html"))
    gone = F.when(F.col("page_id") % 6 == 0, F.concat("url", F.lit("?gone"))).when(F.col("page_id") % 2 == 0, F.col("url"))
    return pg.scan_pages(pages.select("page_id", gone.alias("url")), failed, max_bytes=0, version="page_id").select("page_id", "url", F.length("html").alias("size"))


@register
def group_links(spark, sf):
    index = _crawled_index(spark, sf)
    links = pg.group_links(index.drop("source").withColumn("source", F.col("index_url")), "/", "th")
    return links.select(F.col("source").alias("index_url"), "pos", "group", "url")


@register
def url_resolution(spark, sf):
    anchors = pg.anchors(ad.spread(ad.table(spark, sf, "pages").select("page_id", "url", "html")))
    return anchors.select(
        "page_id", "idx", "href", F.col("target").alias("resolved"), without_fragment(F.col("target")).alias("page_url")
    )


def _member_pages(spark: SparkSession, sf: str) -> DataFrame:
    sources = ad.rendered_sources(spark, sf).filter("doc_type = 'doxygen'")
    pages = ad.rendered_pages(spark, sf).filter(F.col("url").contains("/group__"))
    site = F.regexp_extract("url", "^https://(lib[0-9]+)", 1)
    number = F.regexp_extract("url", "_p([0-9])", 1).cast("int")
    return pages.select(site.alias("name"), number.alias("page_ord"), F.col("url").alias("page_url"), "html").join(
        sources.select("name", F.col("name").alias("source"), "source_ord", "default_domain", "cpp_groups"), "name"
    )


@register
def page_members(spark, sf):
    found = pg.member_symbols(_member_pages(spark, sf))
    return found.select("source", "group", "url", "role", "domain")


@register
def member_domain(spark, sf):
    sources = ad.rendered_sources(spark, sf)
    page = F.concat(F.lit("group__g_p"), F.col("p_partkey") % 10, F.lit(".html"))
    parts = ad.table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("lib"), F.floor(F.col("p_partkey") / ad.SOURCE_PARTS)).alias("name"),
        page.alias("page_url"),
    )
    default = F.when(F.col("p_partkey") % 3 != 0, F.col("default_domain"))
    patterns = F.when(F.col("p_partkey") % 7 != 0, F.col("cpp_groups"))
    joined = parts.join(sources.select("name", "default_domain", "cpp_groups"), "name")
    return joined.select("p_partkey", tx.page_domain(F.col("page_url"), patterns, default).alias("domain"))


@register
def index_entries(spark, sf):
    sources = ad.rendered_sources(spark, sf).filter("doc_type = 'sphinx_noinv'")
    wanted = sources.select(
        F.col("name").alias("source"), "source_ord", registry.index_page_url(F.col("index_url")).alias("index_page_url")
    )
    found = pg.index_symbols(pg.scan_pages(wanted, ad.rendered_pages(spark, sf), "index_page_url"))
    return found.select("source", "pos", "group", "url", "role", "domain", "origin")


@register
def inventory_symbols(spark, sf):
    files = ad.rendered_inventories(spark, sf)
    sources = ad.rendered_sources(spark, sf).filter("doc_type = 'sphinx'")
    located = sources.select(
        F.col("name").alias("source"),
        "source_ord",
        F.concat(F.lit("https://"), "name", F.lit(".example.com/v2/objects.inv")).alias("inventory_url"),
    )
    found = inventory.inventory_symbols(inventory.inventory_objects(files), located)
    return found.select("source", "pos", "group", "url", "role", "domain")


@register
def inventory_files(spark, sf):
    """Inventories written as files to the checkpoint folder, read back with a filter on the domain in the scan."""
    folder = _folder(spark, "inventories")
    objects = ad.rendered_objects(spark, sf)
    file = F.concat("source", F.lit("/objects.inv"))
    inventory.write_inventories(objects.select(file.alias("file"), F.col("p_partkey").alias("line_no"), "name", "domain", "role", "uri"), folder)
    read = inventory.read_inventories(spark, folder).filter(F.col("domain").isin("cpp", "py"))
    source = F.regexp_extract("url", "/([^/]*)/objects.inv$", 1)
    base = F.concat(F.lit("https://"), source, F.lit(".example.com/v2/objects.inv"))
    target = plain_join(base, F.replace("uri", F.lit("$"), F.col("name")))
    return read.select(source.alias("source"), F.col("line_no").alias("pos"), F.col("name").alias("group"), target.alias("url"), "role", "domain", "intact")


def _catalog(spark: SparkSession, sf: str):
    """Catalog of the rendered artifacts, which are written like the tables they stand for."""
    return gather(
        stored(ad.rendered_sources(spark, sf)),
        stored(ad.rendered_log(spark, sf)),
        stored(ad.rendered_inventories(spark, sf)),
        stored(ad.rendered_pages(spark, sf)),
    )


@register
def gather_symbols(spark, sf):
    symbols = _catalog(spark, sf).symbols
    return symbols.select("source", "kind", "group", "url", "role", "domain", "origin")


@register
def gather_status(spark, sf):
    status = _catalog(spark, sf).status
    return status.select("source", "doc_type", "inventory_url", "skipped_reason", "doc_url")


@register
def text_tree_rendered(spark, sf):
    return with_text_tree(ad.rendered_documents(spark, sf), section=F.concat(F.lit("d"), "doc_id")).select(
        "doc_id", "text_tree", "status"
    )


@register
def text_tree_section(spark, sf):
    key = F.col("doc_id")
    section = (
        F.when(key % 4 == 0, F.lit("NOTE OF"))
        .when(key % 4 == 1, F.lit("missing"))
        .when(key % 4 == 2, F.concat(F.lit("D"), key))
        .otherwise(F.lit("src"))
    )
    return with_text_tree(ad.rendered_documents(spark, sf), section=section).select("doc_id", "text_tree", "status")


@register
def text_tree_pages(spark, sf):
    pages = ad.table(spark, sf, "pages").select("page_id", "html")
    return with_text_tree(ad.spread(pages)).select("page_id", "text_tree", "status")


@register
def noise_filter(spark, sf):
    texts = ad.spread(ad.table(spark, sf, "documents").select("doc_id", "text"))
    docs = texts.select("doc_id", F.explode(F.split("text", "[ \n]")).alias("word"))
    tail = F.concat(F.lit(" "), F.right("word", F.lit(1)), F.lit("\t"))
    return (
        docs.withColumn("tail", tail)
        .groupBy("doc_id")
        .agg(
            F.count_if(tx.is_noise(F.col("word"))).alias("noise_words"),
            F.count_if(tx.is_noise(F.col("tail"))).alias("noise_tails"),
        )
    )


@register
def normalize_whitespace(spark, sf):
    messy = F.concat(F.lit(" \t\n"), F.replace("text", F.lit(". "), F.lit(".\t  \n \t")), F.lit("\n\n"))
    docs = ad.spread(ad.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", tx.normalize_lines(messy).alias("text"))


# --- source health ----------------------------------------------------------


@register
def url_health(spark, sf):
    return au.url_health(ad.crawl_log_events(spark, sf))


def _site_url(number: Column) -> Column:
    return F.concat(F.lit("https://site"), number, F.lit(".example.com/"))


def _object_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Object counts of the inventories the crawl log knows, from the parts spread over them."""
    key = F.col("p_partkey")
    path = ad._pick(key % 4, ["view", "click", "click/", "view/"])
    objects = ad.table(spark, sf, "part").select(
        F.concat(_site_url(F.floor(key / 13)), path).alias("url"),
        key.alias("line_no"),
        ad._pick(F.col("p_size") % 4, ad.DOMAINS).alias("domain"),
    )
    return inventory.inventory_counts(objects)


def _link_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Group links of the index pages the crawl log knows, from pages rendered for the parts."""
    key = F.col("p_partkey")
    href = F.when(F.col("p_size") % 16 == 0, F.lit("group__g.html")).when(F.col("p_size") % 16 == 1, F.lit("modules_group__.html")).otherwise("x.html")
    link = F.concat(F.lit('<a href="'), href, F.lit('">'), "p_name", F.lit("</a>"))
    pages = (
        ad.table(spark, sf, "part")
        .withColumns({"site": F.floor(key / 10), "link": link})
        .groupBy("site")
        .agg(F.array_join(F.collect_list("link"), " ").alias("html"))
        .select(F.concat(_site_url(F.col("site")), F.lit("view"), F.when(F.col("site") % 2 == 1, "/").otherwise("")).alias("url"), "html")
    )
    return pg.group_link_count(pages)


def _health(spark: SparkSession, sf: str) -> DataFrame:
    return au.url_health(ad.crawl_log_events(spark, sf), au.audited_urls(ad.registry_suppliers(spark, sf)))


def _of_type(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return ad.registry_suppliers(spark, sf).filter(F.col("doc_type") == kind)


@register
def audit_inventory(spark, sf):
    return au.inventory_checks(_of_type(spark, sf, "sphinx"), _health(spark, sf), _object_counts(spark, sf))


@register
def audit_index(spark, sf):
    return au.index_checks(_of_type(spark, sf, "doxygen"), _health(spark, sf), _link_counts(spark, sf))


@register
def audit_pdf(spark, sf):
    return au.pdf_checks(_of_type(spark, sf, "pdf"), _health(spark, sf))


@register
def audit_page(spark, sf):
    return au.page_checks(_of_type(spark, sf, "sphinx_noinv"), _health(spark, sf))


@register
def audit_config(spark, sf):
    return au.config_checks(ad.registry_suppliers(spark, sf))


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    sources = ad.registry_suppliers(spark, sf)
    checks = au.all_checks(sources, ad.crawl_log_events(spark, sf), _object_counts(spark, sf), _link_counts(spark, sf))
    return au.roll_up(sources, checks)


@register
def audit_rollup(spark, sf):
    return _audit(spark, sf).withColumn("checks", F.to_json("checks"))


@register
def audit_headline(spark, sf):
    return au.headline(_audit(spark, sf))


@register
def audit_summary(spark, sf):
    return au.summary(_audit(spark, sf))


# --- export -----------------------------------------------------------------


@register
def export_tsv_rows(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    scored = search(symbols, sources, ["lib_1"], "red", True, 83.0)
    plain = search(symbols, sources, ["lib_2"], "gear")
    lines = [export.tsv_rows(r).select("source", "rank", "line") for r in (scored, plain)]
    return lines[0].unionByName(lines[1])


@register
def export_json_envelope(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    queries = ad.query_batch(spark, sf).withColumns({"threshold": F.lit(88.0), "max_results": F.lit(4)})
    requests = ad.batch_requests(queries).filter("request_ord = 0 or query_id not like '%bolt'")
    found, counts = search_and_count(symbols, sources, queries, requests)
    return export.json_lines(found, counts, queries)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid4().hex}"


@register
def fuzzy_search_below_60(spark, sf):
    """Every query of the batch at a threshold of 50, where candidates share single characters only."""
    queries = ad.query_batch(spark, sf).withColumn("threshold", F.lit(50.0))
    return _scored(search_batch(ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf), queries, ad.batch_requests(queries)))


@register
def export_json_whole(spark, sf):
    """The export of all results of the batch, without a limit."""
    queries = ad.query_batch(spark, sf).withColumns({"threshold": F.lit(88.0), "max_results": F.lit(None).cast("int")})
    requests = ad.batch_requests(queries).filter("request_ord = 0 or query_id not like '%bolt'")
    found, counts = search_and_count(ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf), queries, requests)
    return export.json_lines(found, counts, queries)


@register
def export_tsv_files(spark, sf):
    """A result written as TSV files, and their lines with their places."""
    folder = _folder(spark, "tsv")
    export.write_tsv(search(ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf), ["lib_1"], "red", True, 83.0), folder, ["rank"])
    return export.read_lines(spark, folder)


@register
def export_json_files(spark, sf):
    """The export of a batch of queries written as files of JSON lines, and their lines with their places."""
    folder = _folder(spark, "json")
    export.write_json(export_json_envelope(spark, sf), folder)
    return export.read_lines(spark, folder)


def _gathered(spark: SparkSession, sf: str):
    """The gathered catalog with its symbols stored, and the queries and requests put to it."""
    catalog, sources = _catalog(spark, sf), stored(ad.rendered_sources(spark, sf))
    queries = stored(ad.gathered_queries(spark, sf))
    return stored(catalog.symbols), stored(catalog.status), sources, queries, ad.gathered_requests(queries)


@register
def search_gathered(spark, sf):
    symbols, _, sources, queries, requests = _gathered(spark, sf)
    found = search_batch(symbols, sources, queries, requests)
    return found.select("query_id", "source", "url", "score")


@register
def failed_queries(spark, sf):
    requests = ad.gathered_requests(ad.gathered_queries(spark, sf))
    return registry.unknown_sources(requests, ad.rendered_sources(spark, sf)).select("query_id", "requested")


@register
def export_unsearchable(spark, sf):
    symbols, status, sources, queries, requests = _gathered(spark, sf)
    found, counts = search_and_count(symbols, sources, queries, requests)
    asked = registry.canonical_requests(requests, sources).select("query_id", "request_ord", "requested", "source").join(status, "source")
    heads = export.json_lines(found, counts, queries, asked)
    return heads.filter("rank = 0").select("query_id", "line")


@register
def export_stats(spark, sf):
    catalog = _catalog(spark, sf)
    return export.stats_envelopes(catalog.symbols, ad.rendered_sources(spark, sf), catalog.status)


# --- further paths of the search ---------------------------------------------


@register
def search_limit(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    return _scored(search(symbols, sources, ["lib_2", "tag1", "lib_0"], "red widget | bolt | ECON", True, 83.0, limit=20))


def _with_nulls(symbols: DataFrame) -> DataFrame:
    """Every fifth name, seventh address, third role and second domain is missing."""
    kept = lambda n, c: F.when(F.col("pos") % n != 0, F.col(c))
    return symbols.withColumns({c: kept(n, c) for n, c in [(5, "group"), (7, "url"), (3, "role"), (2, "domain")]})


@register
def search_nulls(spark, sf):
    symbols, sources = _with_nulls(ad.symbols_part(spark, sf)), ad.catalog_sources(spark, sf)
    found = search(symbols, sources, ["lib_2", "tag1", "lib_0"], "red widget | bolt | ECON", True, 83.0)
    return _scored(found)


@register
def fuzzy_search_batch_shuffled(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    queries = ad.query_batch(spark, sf)
    return _scored(search_batch(symbols, sources, queries, ad.batch_requests(queries), max_bytes=0))


@register
def fuzzy_search_low_threshold(spark, sf):
    symbols, sources = ad.symbols_part(spark, sf), ad.catalog_sources(spark, sf)
    queries = ad.query_batch(spark, sf).filter("query_id like 'typo%'").withColumn("threshold", F.lit(50.0))
    return _scored(search_batch(symbols, sources, queries, ad.batch_requests(queries)))


@register
def text_tree_main(spark, sf):
    return with_text_tree(ad.main_documents(spark, sf), main_only=True).select("doc_id", "text_tree", "status")
