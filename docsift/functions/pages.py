"""Arrow UDFs that read a page and return what an extraction needs from it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions import html as dom
from docsift.functions.urls import is_plain, plain_join, resolve

# --- fixed values -----------------------------------------------------------
MEMBER_HREF = re.compile(r"^#(group__\w+_1\w+)")
MEMBER_HEADING = ("h3", "member_header")
INDEX_TABLE = ("table", "indextable")
# ----------------------------------------------------------------------------


def _rows(html: pa.Array, fields: list[str], extract: Callable[..., Iterator[dict]], *columns: pa.Array) -> pa.Array:
    """Array of structs per page; empty for a missing page or one that cannot be parsed."""

    def read(page: str | None, *args: str | None) -> list[dict]:
        if page is None:
            return []
        try:
            return list(extract(dom.parse(page), *args))
        except AssertionError:  # raised by the standard parser for markup it rejects
            return []

    kind = pa.list_(pa.struct([(f, pa.string()) for f in fields]))
    pages = zip(html.to_pylist(), *[c.to_pylist() for c in columns])
    return pa.array([read(*page) for page in pages], type=kind)


def _link(a: dom.Element, base: str | None) -> dict:
    """Plain references are resolved in the JVM (``_resolved``)."""
    href = a.attrs["href"]
    return {"href": href, "text": a.stripped_text(""), "url": None if is_plain(base, href) else resolve(base, href)}


def _resolved(links: Column, base: Column) -> Column:
    return F.transform(links, lambda a: F.struct(a["href"].alias("href"), a["text"].alias("text"), F.coalesce(a["url"], plain_join(base, a["href"])).alias("url")))


def _link_rows(root: dom.Element, base: str | None) -> Iterator[dict]:
    for a in dom.links(root):
        yield _link(a, base)


def _member_rows(root: dom.Element) -> Iterator[dict]:
    heading: dom.Element | None = None
    cells: dict[int, str] = {}

    def cell_text(cell: dom.Element) -> str:
        if id(cell) not in cells:
            cells[id(cell)] = re.sub(r"\s+", " ", cell.stripped_text(" ")).strip()
        return cells[id(cell)]

    for node in root.elements():
        if node.name == MEMBER_HEADING[0] and node.has_class(MEMBER_HEADING[1]):
            heading = node
        if node.name != "a" or not MEMBER_HREF.match(node.attrs.get("href", "")):
            continue
        bare = node.stripped_text("")
        around = [cell_text(c) for c in (node.ancestor("td"), node.ancestor("dt")) if c is not None]
        name = next((t for t in around if t and t != bare), bare)
        yield {
            "href": node.attrs["href"],
            "text": name,
            "heading": None if heading is None else heading.stripped_text(""),
        }


def _index_rows(root: dom.Element, base: str | None) -> Iterator[dict]:
    for table in root.elements():
        if table.name == INDEX_TABLE[0] and table.has_class(INDEX_TABLE[1]):
            for item in table.elements():
                if item.name == "li":
                    a = next(dom.links(item), None)
                    if a is not None:
                        yield _link(a, base)


_LINK = ["href", "text", "url"]
_MEMBER = ["href", "text", "heading"]


def _links(html: pa.Array, base: pa.Array) -> pa.Array:
    return _rows(html, _LINK, _link_rows, base)


def _members(html: pa.Array) -> pa.Array:
    return _rows(html, _MEMBER, _member_rows)


def _index(html: pa.Array, base: pa.Array) -> pa.Array:
    return _rows(html, _LINK, _index_rows, base)


# A page is parsed once: declared nondeterministic, a parse is not copied into a
# filter on its result that moves below it.


def page_links(html: Column, base: Column) -> Column:
    """Anchors with an href, in document order; ``url`` is the href resolved against ``base``."""
    return _resolved(F.arrow_udf(_links, "array<struct<href:string,text:string,url:string>>").asNondeterministic()(html, base), base)


def page_members(html: Column) -> Column:
    """Member anchors with their disambiguated name and the section heading before them."""
    return F.arrow_udf(_members, "array<struct<href:string,text:string,heading:string>>").asNondeterministic()(html)


def index_links(html: Column, base: Column) -> Column:
    """First anchor of every list item of the index tables, resolved against ``base``."""
    return _resolved(F.arrow_udf(_index, "array<struct<href:string,text:string,url:string>>").asNondeterministic()(html, base), base)


def _tree(page: str | None, section: str | None, main_only: bool | None) -> dict:
    if not page:
        return {"tree": None, "status": "no content"}
    try:
        root = dom.parse(page)
    except AssertionError:
        return {"tree": None, "status": "no content"}
    dom.clean(root)
    if main_only:
        root = dom.main_content(root)
    if section:
        root = dom.find_section(root, section)
        if root is None:
            return {"tree": None, "status": "section not found"}
    return {"tree": dom.brace_tree(root), "status": "ok"}


def _trees(html: pa.Array, section: pa.Array, main_only: pa.Array) -> pa.Array:
    rows = zip(html.to_pylist(), section.to_pylist(), main_only.to_pylist())
    return pa.array(
        [_tree(*row) for row in rows], type=pa.struct([("tree", pa.string()), ("status", pa.string())])
    )


def page_tree(html: Column, section: Column, main_only: Column) -> Column:
    """Brace tree of a page, of its main content, or of one section."""
    return F.arrow_udf(_trees, "struct<tree:string,status:string>").asNondeterministic()(html, section, main_only)
