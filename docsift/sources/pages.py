"""Symbols and links extracted from crawled pages.

Every function reads a ``pages`` relation (url, html); a page that was not
fetched has no row or a NULL html and contributes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as tx
from docsift.functions.pages import index_links, page_links, page_members
from docsift.functions.urls import without_fragment
from docsift.operators import bloom
from docsift.operators.ranking import first_by
from docsift.operators.sizing import broadcast_if_small
from docsift.operators.storage import stored

# --- fixed values -----------------------------------------------------------
GROUP_MARK = "group__"
OVERVIEW_MARK = "modules"
# ----------------------------------------------------------------------------

# Members rank after all group links; a page or link list has far fewer than 2^30 anchors.
MEMBER_POS_BASE = 1 << 60
PAGE_POS_STEP = 1 << 30


def scan_pages(
    wanted: DataFrame, pages: DataFrame, url: str = "url", max_bytes: int | None = None, version: str | None = None
) -> DataFrame:
    """Rows of ``wanted`` with the html of their page, each at most once; those without one are dropped.

    A crawl may hold an address several times. ``version`` names the column of both relations that then tells its pages
    apart, and a wanted row gets the page it names. Without it the least html of the address counts.

    Few pages are wanted out of many: while the wanted rows measure small they are broadcast, so that no body of another
    page is shuffled to find them. Beyond that a Bloom filter of their addresses, of bounded size, is broadcast instead:
    only pages that pass it, the wanted ones and about one in a hundred others, move to the exact join.
    """
    keys = [url] if version is None else [url, version]
    columns = [F.col("url").alias(url), *keys[1:], "html"]
    fetched = pages.filter(F.col("html").isNotNull()).select(*columns)
    wanted, small = broadcast_if_small(wanted, max_bytes)
    if not small:
        n = wanted.select(F.approx_count_distinct(url)).first()[0]
        addresses = stored(bloom.segments(wanted.select(F.xxhash64(url).alias("h")), "h", n))
        fetched = bloom.probed(fetched, F.xxhash64(url), addresses, n)
    if version is None:
        if small:
            fetched = fetched.join(F.broadcast(wanted.select(url)), url, "left_semi")
        fetched = fetched.groupBy(url).agg(F.min("html").alias("html"))
    return fetched.join(wanted, keys)


def anchors(pages: DataFrame) -> DataFrame:
    """Pages (with a ``url``) with one row per anchor: idx, href, text and the resolved target."""
    others = [c for c in pages.columns if c != "html"]
    links = page_links(F.col("html"), F.col("url"))
    return pages.select(*others, links.alias("_l")).select(*others, F.posexplode("_l").alias("idx", "_a")).select(
        *others, "idx", "_a.href", "_a.text", F.col("_a.url").alias("target")
    )


def group_entries(
    index_pages: DataFrame, href_contains: str = GROUP_MARK, href_excludes: str = OVERVIEW_MARK
) -> DataFrame:
    """Index pages (source, source_ord, index_url, html) with the anchors to group pages in place of the html."""
    links = F.transform(
        page_links(F.col("html"), F.col("index_url")),
        lambda a, i: F.struct(i.alias("pos"), a["href"].alias("href"), a["text"].alias("text"), a["url"].alias("url")),
    )
    wanted = lambda a: a["href"].contains(href_contains) & ~a["href"].contains(href_excludes)
    return index_pages.withColumn("_links", F.filter(links, wanted)).drop("html")


def links_of(entries: DataFrame) -> DataFrame:
    """Group links of ``group_entries``: the first link to each page counts and keeps its fragment.

    A page with a malformed link among them fails as a whole, see ``broken_of``.
    """
    found = (
        entries.filter(~F.exists("_links", lambda a: a["url"].isNull()))
        .select("source", "source_ord", F.explode("_links").alias("_a"))
        .select(
            "source",
            "source_ord",
            without_fragment(F.col("_a.url")).alias("page_url"),
            "_a.pos",
            F.col("_a.text").alias("group"),
            "_a.url",
        )
    )
    return first_by(found, ["source", "page_url"], ["pos"])


def broken_of(entries: DataFrame) -> DataFrame:
    """Sources of ``group_entries`` whose index page links to a malformed address."""
    return entries.filter(F.exists("_links", lambda a: a["url"].isNull())).select("source")


def group_links(
    index_pages: DataFrame, href_contains: str = GROUP_MARK, href_excludes: str = OVERVIEW_MARK
) -> DataFrame:
    """``links_of`` index pages."""
    return links_of(group_entries(index_pages, href_contains, href_excludes))


def broken_indexes(
    index_pages: DataFrame, href_contains: str = GROUP_MARK, href_excludes: str = OVERVIEW_MARK
) -> DataFrame:
    """``broken_of`` index pages."""
    return broken_of(group_entries(index_pages, href_contains, href_excludes))


def group_link_count(pages: DataFrame, mark: str = GROUP_MARK) -> DataFrame:
    """(url, n_links): anchors per page whose href holds the mark, counted before any dedup."""
    hits = F.filter(page_links(F.col("html"), F.col("url")), lambda a: a["href"].contains(mark))
    return pages.filter(F.col("html").isNotNull()).select("url", F.size(hits).cast("long").alias("n_links"))


def member_symbols(member_pages: DataFrame) -> DataFrame:
    """Members of group pages.

    ``member_pages`` has source, source_ord, page_ord, page_url, html,
    default_domain and cpp_groups.  The first row per URL over all pages of a
    source counts.
    """
    keep = ["source", "source_ord", "page_ord", "page_url", "default_domain", "cpp_groups"]
    found = (
        member_pages.select(*keep, page_members(F.col("html")).alias("_l"))
        .select(*keep, F.posexplode("_l").alias("idx", "_m"))
        .filter(F.col("_m.text") != "")
        .select(
            "source",
            "source_ord",
            (F.lit(MEMBER_POS_BASE) + F.col("page_ord").cast("long") * PAGE_POS_STEP + F.col("idx")).alias("pos"),
            F.lit("member").alias("kind"),
            F.col("_m.text").alias("group"),
            F.concat("page_url", "_m.href").alias("url"),
            tx.section_role(F.col("_m.heading")).alias("role"),
            tx.page_domain(F.col("page_url"), F.col("cpp_groups"), F.col("default_domain")).alias("domain"),
            F.lit(None).cast("string").alias("origin"),
        )
    )
    return first_by(found, ["source", "url"], ["pos"])


def general_entries(index_pages: DataFrame) -> DataFrame:
    """General index pages (source, source_ord, index_page_url, html) with their entries in place of the html."""
    links = F.transform(
        index_links(F.col("html"), F.col("index_page_url")),
        lambda a, i: F.struct(i.alias("pos"), a["text"].alias("text"), a["url"].alias("url")),
    )
    is_entry = lambda a: a["text"].rlike(tx.INDEX_ENTRY)
    return index_pages.withColumn("_entries", F.filter(links, is_entry)).drop("html")


def index_symbols(index_pages: DataFrame) -> DataFrame:
    """``symbols_of`` general index pages."""
    return symbols_of(general_entries(index_pages))


def symbols_of(entries: DataFrame) -> DataFrame:
    """Symbols of ``general_entries``; a page with a malformed link among its entries fails as a whole."""
    intact = entries.filter(~F.exists("_entries", lambda a: a["url"].isNull()))
    found = intact.select("source", "source_ord", F.explode("_entries").alias("_e"))
    part = lambda i: F.regexp_extract("_e.text", tx.INDEX_ENTRY, i)
    return found.select(
        "source",
        "source_ord",
        F.col("_e.pos").cast("long").alias("pos"),
        F.lit("index").alias("kind"),
        part(1).alias("group"),
        "_e.url",
        part(3).alias("role"),
        tx.language_domain(part(2)).alias("domain"),
        F.lit("genindex").alias("origin"),
    )


def index_state(index_pages: DataFrame) -> DataFrame:
    """``state_of`` general index pages."""
    return state_of(general_entries(index_pages))


def state_of(entries: DataFrame) -> DataFrame:
    """(source, entries, broken) of ``general_entries``: entry count, and whether a link is malformed."""
    return entries.select(
        "source",
        F.size("_entries").alias("entries"),
        F.exists("_entries", lambda a: a["url"].isNull()).alias("broken"),
    )
