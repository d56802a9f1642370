"""URL resolution: plain references in the JVM, odd ones in Python."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Both engines read these patterns alike; the last group is the end of the text, which ``$`` is not before a line break.
_END = r"(?![\s\S])"
PLAIN_BASE = r"^https?://[A-Za-z0-9.:-]+(/[^?#;\x00-\x20]*)?(\?[^#\x00-\x20]*)?(#[^\x00-\x20]*)?" + _END
PLAIN_HREF = r"^(?![\x00-\x20])(?!//)(?![^/?#]*:)[^?#;\x00-\x1f]*(\?[^#\x00-\x1f]*)?(#[^\x00-\x1f]*)?" + _END
_BASE, _HREF = re.compile(PLAIN_BASE), re.compile(PLAIN_HREF)


def resolve(base: str | None, href: str | None) -> str | None:
    """RFC 3986 join; None where either side is missing or the URL is malformed."""
    if base is None or href is None:
        return None
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def is_plain(base: str | None, href: str | None) -> bool:
    """Whether ``plain_join`` resolves the pair."""
    return base is not None and href is not None and bool(_BASE.match(base)) and bool(_HREF.match(href))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(path: Column) -> Column:
    """A path that begins with a slash, without dot segments."""
    none = F.array().cast("array<string>")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, s: F.when(s == "..", up(done)).when(s == ".", done).otherwise(F.array_append(done, s))
    rooted = lambda done: _let(F.array_join(done, "/"), lambda j: F.when(j.startswith("/"), j).otherwise(F.concat(F.lit("/"), j)))
    closed = F.regexp_replace(path, r"(/\.\.?)" + _END, "$1/")
    return _let(closed, lambda p: F.when(p.contains("/."), F.aggregate(F.split(p, "/", -1), none, step, rooted)).otherwise(p))


def plain_join(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base`` without Python; NULL unless both are plain (see ``is_plain``).

    Plain are references without a scheme or host of their own to an http(s) address without parameters. The path's
    segments are folded once: ``..`` takes the last one off and ``.`` vanishes, as do empty ones of a path that is not absolute.
    """
    part = lambda url, pattern: F.regexp_extract(url, pattern, 1)

    def join(x: Column) -> Column:
        after = lambda mark, text: F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(mark), text))
        folder = F.coalesce(F.nullif(F.regexp_replace(x["base_path"], "[^/]+" + _END, ""), F.lit("")), F.lit("/"))  # to the last slash
        beside = F.regexp_replace(F.concat(folder, x["path"]), "/{2,}", "/")
        whole = F.when(x["path"].startswith("/"), x["path"]).otherwise(beside)
        path = F.when(x["path"] == "", x["base_path"]).otherwise(_folded(whole))
        query = F.when((x["path"] == "") & (x["query"] == ""), x["base_query"]).otherwise(x["query"])
        return F.concat(x["site"], path, after("?", query), after("#", x["fragment"]))

    parts = F.struct(
        part(base, "^(https?://[^/?#]*)").alias("site"),
        part(base, "^https?://[^/?#]*([^?#]*)").alias("base_path"),
        part(base, r"^[^?#]*\?([^#]*)").alias("base_query"),
        part(href, r"^([^?#]*)").alias("path"),
        part(href, r"^[^?#]*\?([^#]*)").alias("query"),
        part(href, r"^[^#]*#(.*)").alias("fragment"),
    )
    return F.when(base.rlike(PLAIN_BASE) & href.rlike(PLAIN_HREF), F.when(href == "", base).otherwise(_let(parts, join)))


def _resolve_batch(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) for b, h in zip(base, href)], dtype=object)


def url_join(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base``; NULL if malformed. Only odd pairs carry text to Python."""
    plain = plain_join(base, href)
    # Nondeterministic: filters on the result must not evaluate it a second time.
    join = F.pandas_udf(_resolve_batch, T.StringType()).asNondeterministic()
    odd = plain.isNull()
    return F.coalesce(plain, join(F.when(odd, base), F.when(odd, href)))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)
