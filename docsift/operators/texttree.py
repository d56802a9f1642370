"""Compact text trees of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.pages import page_tree
from docsift.functions.text import normalize_lines


def with_text_tree(
    pages: DataFrame, section: Column | None = None, main_only: Column | bool = False
) -> DataFrame:
    """Add ``text_tree`` and ``status`` (ok | no content | section not found) to a page relation.

    ``section`` and ``main_only`` may differ per row.
    """
    wanted = F.lit(None).cast("string") if section is None else section
    main = F.lit(main_only) if isinstance(main_only, bool) else main_only
    others = [c for c in pages.columns if c != "html"]
    return pages.select(*others, page_tree(F.col("html"), wanted, main).alias("_t")).select(
        *others, normalize_lines(F.col("_t.tree")).alias("text_tree"), F.col("_t.status").alias("status")
    )
