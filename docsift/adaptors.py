"""Views of the benchmark tables in the schemas of this package.

The tables stand in for a crawl: ``part`` for symbols, ``supplier`` for the
registry, ``events`` for the crawl log, ``documents`` and ``pages`` for pages.
Rendered artifacts are cut into pages and inventories of bounded size, so that
their number, not their size, grows with the tables.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.schemas import CRAWL_LOG

SITE = "https://docs.example.com"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """The scan over all cores.

    A benchmark table is one file with one row group, hence one task.  A table
    with at least as many splits as cores is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _pick(number: Column, values: list[str | None]) -> Column:
    out = F.lit(values[-1])
    for i, value in reversed(list(enumerate(values[:-1]))):
        out = F.when(number == i, F.lit(value)).otherwise(out)
    return out


ROLES = ["function", "type", "enum", "macro", "enumerator", "data", "label", "", "class"]
DOMAINS = ["cpp", "c", "py", "std"]


def words() -> tuple[Column, Column]:
    return F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))


def camel_name() -> Column:
    first, second = words()
    return F.concat("p_type", F.lit("_"), first, F.upper(F.left(second, F.lit(1))), F.substr(second, F.lit(2)))


def symbols_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search catalog of three sources in which two rows share each URL."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return spread(parts).select(
        F.concat(F.lit("lib_"), key % 3).alias("source"),
        (key % 3).cast("int").alias("source_ord"),
        key.alias("pos"),
        F.lit("inventory").alias("kind"),
        camel_name().alias("group"),
        F.concat(F.lit(f"{SITE}/item/"), key - key % 12 + key % 6).alias("url"),
        _pick(F.col("p_size") % 9, ROLES).alias("role"),
        _pick(key % 4, DOMAINS).alias("domain"),
        F.lit(None).cast("string").alias("origin"),
    )


def catalog_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry rows of the sources of ``symbols_part``, found from the catalog itself."""
    number = F.substr("source", F.lit(5)).cast("int")
    key = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part")
        .select(F.concat(F.lit("lib_"), key % 3).alias("source"), (key % 3).cast("int").alias("source_ord"))
        .distinct()
        .select(
            F.col("source").alias("name"),
            "source_ord",
            F.lit("sphinx").alias("doc_type"),
            F.lit(None).cast("string").alias("doc_url"),
            F.lit(None).cast("string").alias("index_url"),
            F.when(number == 1, F.lit(70.0)).alias("match_threshold"),
            F.array(F.concat(F.lit("Tag"), number)).alias("tags"),
        )
    )


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries made of the words of the part names: AND, OR, misspelt, boolean and pipe-only."""
    first, second = words()
    pairs = table(spark, sf_dir, "part").select(first.alias("w1"), second.alias("w2")).distinct()
    swapped = F.concat(
        F.left("w2", F.lit(1)), F.substr("w2", F.lit(3), F.lit(1)), F.substr("w2", F.lit(2), F.lit(1)), F.substr("w2", F.lit(4))
    )
    shapes = F.array(
        *[
            F.struct(F.lit(tag).alias("tag"), keywords.alias("keywords"), F.lit(fuzzy).alias("fuzzy"))
            for tag, keywords, fuzzy in [
                ("and", F.concat("w1", F.lit(" "), "w2"), True),
                ("or", F.concat(F.upper("w1"), F.lit(" | "), "w2"), True),
                ("typo", F.concat("w1", F.lit(" "), swapped), True),
                ("bool", F.concat("w1", F.lit(" | "), "w2"), False),
                ("pipe", F.lit("|"), True),
            ]
        ]
    )
    has = lambda w: F.col("w1").isin(w) | F.col("w2").isin(w)
    threshold = F.when(has(["red"]), F.lit(65.0)).when(has(["hot"]), F.lit(83.0))
    return pairs.select("w1", "w2", F.explode(shapes).alias("s")).select(
        F.concat_ws("-", "s.tag", "w1", "w2").alias("query_id"),
        "s.keywords",
        F.when(F.col("w2") == "rod", F.lit("cpp, py")).alias("domains"),
        "s.fuzzy",
        threshold.alias("threshold"),
        F.when(F.col("w1") == "cold", F.lit(7)).cast("int").alias("max_results"),
    )


def batch_requests(queries: DataFrame) -> DataFrame:
    """Each query asks for ``lib_2`` by a tag and then for ``lib_1``, some also for ``lib_0`` twice."""
    more = F.col("query_id").endswith("gear")
    asked = F.concat(
        F.array(F.lit("tag2"), F.lit("lib_1")),
        F.when(more, F.array(F.lit("lib_0"), F.lit("TAG0"))).otherwise(F.array().cast("array<string>")),
    )
    return queries.select("query_id", F.posexplode(asked).alias("request_ord", "requested"))


def registry_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with one source per supplier; addresses are those of the crawl log.

    Region tags are shared by many sources on purpose; some rows are broken.
    """
    key = F.col("s_suppkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    site = lambda shift: F.concat(F.lit("https://site"), key + shift, F.lit(".example.com/"))
    empty = F.array().cast("array<string>")
    kind = _pick(key % 6, ["sphinx", "doxygen", "sphinx_noinv", "pdf", "wiki", None])
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.when(key % 17 != 16, F.col("s_name")).alias("name"),
            key.cast("int").alias("source_ord"),
            F.when(key % 3 == 0, F.concat(F.lit("Docs of "), "n_name")).alias("description"),
            kind.alias("doc_type"),
            F.when(
                (key % 6 == 0) & (key % 4 != 2),
                F.array(F.concat(site(0), F.lit("view")), F.concat(site(1), F.lit("click"))),
            ).alias("inventory_urls"),
            F.when(
                ((key % 6 == 1) | (key % 6 == 2)) & (key % 5 != 0), F.concat(site(0), F.lit("view"))
            ).alias("index_url"),
            F.when(
                (key % 6 == 3) & (key % 7 != 0),
                F.concat(site(0), F.when(key % 2 == 0, F.lit("view")).otherwise(F.lit("error"))),
            ).alias("doc_url"),
            F.when((key % 6 == 0) & (key % 5 != 0), F.array(F.concat(site(2), F.lit("signup//")), site(3))).alias(
                "base_urls"
            ),
            F.when(key % 4 == 0, F.lit(70.0)).alias("match_threshold"),
            F.when(
                key % 9 != 8, F.array(F.lower("r_name"), F.concat(F.lit("alias_"), key))
            ).otherwise(F.when(key % 2 == 0, empty)).alias("tags"),
            F.lit(None).cast("string").alias("repo"),
            F.when(key % 2 == 0, F.lit("c")).alias("default_domain"),
            F.lit(None).cast("array<string>").alias("cpp_groups"),
            F.when(key % 12 == 0, F.concat(site(4), F.lit("purchase"))).alias("override_url"),
        )
    )


def customer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three names per customer: an exact name, a tag in another case, a region or an unknown name."""
    key = F.col("c_custkey")
    region = _pick(key % 4, ["AFRICA", "Asia", "nowhere", "europe"])
    asked = F.array(
        F.concat(F.lit("Supplier#"), F.lpad((key % 150).cast("string"), 9, "0")),
        F.concat(F.lit("ALIAS_"), key % 120),
        region,
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), key).alias("query_id"), F.posexplode(asked).alias("request_ord", "requested")
    )


def crawl_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl log with many fetches per URL."""
    key = F.col("event_id")
    url = F.concat(F.lit("https://site"), "user_id", F.lit(".example.com/"), "event_type")
    failed = key % 11 == 0
    return table(spark, sf_dir, "events").select(
        url.alias("url"),
        F.when(~failed, F.when(key % 7 == 0, 404).otherwise(200)).cast("int").alias("status"),
        F.when(~failed, F.when(key % 5 == 0, F.concat(url, F.lit("/"))).otherwise(url)).alias("final_url"),
        F.when(~failed, F.when(F.col("event_type") == "view", "text/HTML; charset=utf-8").otherwise("application/pdf")).alias(
            "content_type"
        ),
        F.when(failed, F.lit("timed out")).alias("error"),
        F.col("ts").alias("fetched_at"),
    )


def escape(text: Column) -> Column:
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _joined(entries: Column, order: str) -> Column:
    """Concatenate the text of a bounded group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, entries.alias("t")))), lambda e: e["t"]), "")


# Parts per rendered source, and per page of a rendered source.
SOURCE_PARTS = 50
PAGE_PARTS = 10


def _rendered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    src = F.floor(key / SOURCE_PARTS)
    return table(spark, sf_dir, "part").withColumns(
        {
            "src": src,
            "page": F.floor(key / PAGE_PARTS),
            "kind": _pick(src % 5, ["sphinx", "doxygen", "sphinx_noinv", "pdf", "wiki"]),
            "site": F.concat(F.lit("https://lib"), src, F.lit(".example.com/")),
        }
    )


def rendered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of the rendered sources: every fifth is of one type."""
    site = F.col("site")
    src = F.col("src")
    return (
        _rendered_parts(spark, sf_dir)
        .select("src", "kind", "site")
        .distinct()
        .select(
            F.concat(F.lit("lib"), src).alias("name"),
            src.cast("int").alias("source_ord"),
            F.col("kind").alias("doc_type"),
            F.when(F.col("kind") == "sphinx", F.array(F.concat(site, F.lit("old/objects.inv")))).alias("inventory_urls"),
            F.when(F.col("kind") == "sphinx", F.array(F.concat(site, F.lit("latest")))).alias("base_urls"),
            F.when(F.col("kind") == "doxygen", F.concat(site, F.lit("modules.html")))
            .when(F.col("kind") == "sphinx_noinv", site)
            .alias("index_url"),
            F.when(F.col("kind") == "pdf", F.concat(site, F.lit("manual.pdf"))).alias("doc_url"),
            F.lit(None).cast("string").alias("override_url"),
            F.lit("c").alias("default_domain"),
            F.array(F.lit("p1.html"), F.lit("p4.html")).alias("cpp_groups"),
            F.lit(None).cast("double").alias("match_threshold"),
            F.array(F.concat(F.lit("L"), src)).alias("tags"),
        )
    )


def rendered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl log of the rendered sources; ``latest`` redirects to ``v2/``, every tenth inventory is gone."""
    fetch = lambda path, status, final: F.struct(
        F.lit(path).alias("path"), status.cast("int").alias("status"), F.lit(final).alias("final")
    )
    fetched = F.array(
        fetch("old/objects.inv", F.lit(404), "old/objects.inv"),
        fetch("latest", F.lit(200), "v2/index.html"),
        fetch("v2/objects.inv", F.when(F.col("src") % 10 == 5, 410).otherwise(200), "v2/objects.inv"),
    )
    return (
        rendered_sources(spark, sf_dir)
        .filter("doc_type = 'sphinx'")
        .select(
            F.concat(F.lit("https://"), "name", F.lit(".example.com/")).alias("site"),
            F.col("source_ord").alias("src"),
        )
        .select("site", F.explode(fetched).alias("f"))
        .select(
            F.concat("site", "f.path").alias("url"),
            "f.status",
            F.concat("site", "f.final").alias("final_url"),
            F.lit("").alias("content_type"),
            F.lit(None).cast("string").alias("error"),
            F.lit("2024-01-01").cast("timestamp").alias("fetched_at"),
        )
        .select(*CRAWL_LOG.fieldNames())
    )


def _deflate(body: pa.Array) -> pa.Array:
    head = "# Sphinx inventory version 2\n# Project: x\n# Version: 1\n# The rest is compressed\n"
    return pa.array([head.encode() + zlib.compress(b.encode()) for b in body.to_pylist()], pa.binary())


def rendered_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of one inventory per ``sphinx`` source; half of the uris abbreviate the name, some names have a space."""
    key = F.col("p_partkey")
    name = F.when(key % 7 == 0, F.col("p_name")).otherwise(camel_name())
    uri = F.concat(F.lit("api/"), key, F.when(key % 2 == 0, F.lit(".html#$")).otherwise(F.lit(".html")))
    role = F.when(F.col("p_size") % 9 == 7, "class").otherwise(_pick(F.col("p_size") % 9, ROLES))
    return (
        _rendered_parts(spark, sf_dir)
        .filter("kind = 'sphinx'")
        .select(F.concat(F.lit("lib"), "src").alias("source"), "site", "p_partkey", name.alias("name"), _pick(key % 4, DOMAINS).alias("domain"), role.alias("role"), uri.alias("uri"))
    )


def rendered_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rendered_objects`` as inventory files."""
    line = F.concat("name", F.lit(" "), "domain", F.lit(":"), "role", F.lit(" 1 "), "uri", F.lit(" -\n"))
    return (
        rendered_objects(spark, sf_dir)
        .groupBy("site")
        .agg(_joined(line, "p_partkey").alias("body"))
        .select(F.concat("site", F.lit("v2/objects.inv")).alias("url"), F.arrow_udf(_deflate, "binary")("body").alias("content"))
    )


SECTION_TITLES = ["Functions", "Typedefs", "Enumerations", "Defines", "Variables", "Notes"]


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index, group and general index pages of the rendered sources."""
    parts = _rendered_parts(spark, sf_dir)
    key = F.col("p_partkey")
    page_path = F.concat(F.lit("group__g_p"), F.col("page") % 5, F.lit(".html"))
    link = F.concat(
        F.lit('<li><a href="'), page_path, F.lit("#k"), key, F.lit('"> Group '), F.col("page"), F.lit("</a></li>")
    )
    modules = (
        parts.filter("kind = 'doxygen'")
        .groupBy("site")
        .agg(_joined(link, "p_partkey").alias("body"))
        .select(
            F.concat("site", F.lit("modules.html")).alias("url"),
            F.concat(
                F.lit('<html><a href="modules.html#group__top">Modules</a><ul>'), "body", F.lit("</ul></html>")
            ).alias("html"),
        )
    )
    heading = F.concat(
        F.lit('<h3 class="fake_sectiontitle member_header">'), _pick(F.col("p_size") % 6, SECTION_TITLES), F.lit("</h3>")
    )
    anchor = F.concat(F.lit('<a href="#group__g_1g'), key - key % 4, F.lit('">'), camel_name(), F.lit("</a>"))
    row = F.when(
        key % 3 == 0, F.concat(F.lit("<dl><dt><span>"), anchor, F.lit(" ( int "), F.col("p_size"), F.lit(" )</span></dt></dl>"))
    ).when(
        key % 3 == 1, F.concat(F.lit("<dl><dt>skip<table><tr><td>"), anchor, F.lit("\n  (void) </td></tr></table></dt></dl>"))
    ).otherwise(F.concat(F.lit("<p>"), anchor, F.lit("</p>")))
    head = F.when((key % 5 != 1), heading).otherwise(F.lit(""))
    groups = (
        parts.filter("kind = 'doxygen'")
        .groupBy("site", "page")
        .agg(_joined(F.concat(head, row), "p_partkey").alias("body"))
        .select(F.concat("site", page_path).alias("url"), F.concat(F.lit("<html>"), "body", F.lit("</html>")).alias("html"))
    )
    language = _pick(key % 4, ["C++", "C", "Python", "Rust"])
    entry = F.concat(
        F.lit('<li><a href="api.html#e'), key, F.lit('">'), camel_name(), F.lit(" ("), language, F.lit(" "),
        F.when(key % 8 == 3, F.lit("module attribute")).otherwise(F.lit("function")), F.lit(")</a></li>"),
    )
    index = (
        parts.filter("kind = 'sphinx_noinv' and src % 10 != 7")
        .groupBy("site")
        .agg(_joined(entry, "p_partkey").alias("body"))
        .select(
            F.concat("site", F.lit("genindex.html")).alias("url"),
            F.concat(
                F.lit('<ul><li><a href="x">outside (C function)</a></li></ul><table class="indextable genindextable"><tr><td><ul>'),
                "body",
                F.lit("</ul></td></tr></table>"),
            ).alias("html"),
        )
    )
    return modules.unionByName(groups).unionByName(index)


def rendered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with two sections: the document and a note."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).select(
        "doc_id",
        F.concat(F.lit(f"{SITE}/doc/"), "doc_id").alias("url"),
        F.concat(
            F.lit('<body><div><h2 id="d'), "doc_id", F.lit('">'), "source", F.lit("</h2><p>"), escape(F.col("text")),
            F.lit("</p></div><section><h3>Note of "), "source", F.lit("</h3><p>lang "), "lang",
            F.lit("</p></section></body>"),
        ).alias("html"),
    )


def main_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages whose main part is an element, an id, a class or the whole page, with hidden text in it."""
    key = F.col("doc_id") % 4
    opening = _pick(key, ["<main>", '<div id="main-content">', '<div class="x main-content">', "<div>"])
    closing = F.when(key == 0, "</main>").otherwise("</div>")
    aside = F.when(key == 3, "").otherwise("<p>beside</p>")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id",
        F.concat(F.lit(f"{SITE}/doc/"), "doc_id").alias("url"),
        F.concat(
            F.lit("<body>"), aside, opening, F.lit('<h2>'), "source", F.lit('</h2><p style="display: none">gone</p><p>'),
            escape(F.col("text")), F.lit("</p>"), closing, F.lit("</body>"),
        ).alias("html"),
    )


def gathered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries per rendered source: boolean, fuzzy and without keywords; every third source for one domain."""
    shapes = F.array(
        *[
            F.struct(F.lit(tag).alias("tag"), F.lit(keywords).alias("keywords"), F.lit(fuzzy).alias("fuzzy"))
            for tag, keywords, fuzzy in [("b", "GEAR", False), ("f", "red", True), ("l", " ", False)]
        ]
    )
    return rendered_sources(spark, sf_dir).select("source_ord", F.explode(shapes).alias("s")).select(
        F.concat_ws("-", "s.tag", "source_ord").alias("query_id"),
        "s.keywords",
        F.when(F.col("source_ord") % 3 == 1, "cpp").alias("domains"),
        "s.fuzzy",
        F.lit(88.0).alias("threshold"),
        F.lit(None).cast("int").alias("max_results"),
    )


def gathered_requests(queries: DataFrame) -> DataFrame:
    """Boolean queries ask for their source and some for an unknown one, fuzzy ones for a tag and an earlier source."""
    tag, src = F.substring_index("query_id", "-", 1), F.substring_index("query_id", "-", -1).cast("int")
    asked = (
        F.when((tag == "b") & (src % 7 == 6), F.array(F.concat(F.lit("lib"), src), F.lit("nowhere")))
        .when(tag == "f", F.array(F.concat(F.lit("l"), src), F.concat(F.lit("lib"), src - src % 5)))
        .otherwise(F.array(F.concat(F.lit("lib"), src)))
    )
    return queries.select("query_id", F.posexplode(asked).alias("request_ord", "requested"))
