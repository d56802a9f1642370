"""From the registry and crawled artifacts to one symbol relation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.sizing import broadcast_if_small
from docsift.operators.storage import stored
from docsift.schemas import SYMBOL_COLUMNS
from docsift.sources import inventory, pages as pg, registry


@dataclass(frozen=True)
class Catalog:
    symbols: DataFrame
    status: DataFrame


def gather_symbols(
    sources: DataFrame,
    crawl_log: DataFrame,
    inventories: DataFrame,
    pages: DataFrame,
    default_index_url: str | None = None,
) -> Catalog:
    """Symbols of all sources, extracted by source type, and the status of each source.

    Index pages are parsed once, into tables in the checkpoint folder.  ``inventories`` holds (url, content) by final URL.  Domain filters belong to
    the queries: the status of a source is decided on its unfiltered rows.
    """
    base = sources.withColumnRenamed("name", "source")

    reachable = registry.first_reachable(sources.filter("doc_type = 'sphinx'"), crawl_log)
    located = reachable.join(base.select("source", "source_ord"), "source")
    used, _ = broadcast_if_small(located.select(F.col("inventory_url").alias("url")).distinct())
    objects = inventory.inventory_objects(inventories.join(used, "url", "left_semi"))
    from_inventory = inventory.inventory_symbols(objects, located)

    doxygen = base.filter("doc_type = 'doxygen'").withColumn(
        "index_url", F.coalesce("index_url", F.lit(default_index_url))
    )
    index_pages = pg.scan_pages(doxygen.select("source", "source_ord", "index_url"), pages, "index_url")
    # Parsed once: links, members and status all read the stored entries.
    group_entries = stored(pg.group_entries(index_pages))
    links = pg.links_of(group_entries)
    from_links = links.select(
        "source",
        "source_ord",
        F.col("pos").cast("long").alias("pos"),
        F.lit("group").alias("kind"),
        "group",
        "url",
        *[F.lit(None).cast("string").alias(c) for c in ("role", "domain", "origin")],
    )
    wanted = links.select(
        "source", "source_ord", F.col("pos").alias("page_ord"), "page_url"
    ).join(doxygen.select("source", "default_domain", "cpp_groups"), "source")
    from_members = pg.member_symbols(pg.scan_pages(wanted, pages, "page_url"))

    noinv = base.filter("doc_type = 'sphinx_noinv'").select(
        "source", "source_ord", registry.index_page_url(F.coalesce("index_url", F.lit(""))).alias("index_page_url")
    )
    general = pg.scan_pages(noinv, pages, "index_page_url")
    general_entries = stored(pg.general_entries(general))
    from_index = pg.symbols_of(general_entries)

    symbols = from_inventory.select(*SYMBOL_COLUMNS)
    for part in (from_links, from_members, from_index):
        symbols = symbols.unionByName(part.select(*SYMBOL_COLUMNS))
    state = pg.state_of(general_entries)
    broken = pg.broken_of(group_entries).union(state.filter("broken").select("source"))
    status = registry.source_status(sources, reachable, state.filter("entries > 0"), broken)
    return Catalog(symbols, status)
