"""Broadcast decisions that rest on a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 32 << 20


def measured_bytes(df: DataFrame) -> int:
    """Size of a relation as JSON text, from one aggregation job (one row comes back)."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.agg(F.sum(width)).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """The relation with a broadcast hint if it measures small, else as it is.

    Meant for the query, request and registry side of a join.  Beyond the bound
    the join shuffles, and adaptive execution splits skewed partitions.
    """
    limit = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    small = measured_bytes(df) <= limit
    return (F.broadcast(df) if small else df), small
