"""Shards from a consistent-hash ring with virtual nodes and bounded loads (operator 13).

The ring has 65,536 places. Every shard stands at ``VIRTUAL`` of them (its virtual nodes, by a digest of its number), and
a text at the place that its digest names; equal texts share a place. A text belongs to the shard that it meets first
clockwise. No shard takes more than ``1 + SLACK`` times the mean size: what does not fit goes on clockwise to the next
shard with room. So sizes are near equal by construction, whatever the digests do, and one more shard moves little besides
what it takes itself.

Places are the units that are dealt out. A place with more than ``HEAVY`` of a shard's share (a text with very many copies,
a very long text) is cut by digests of ``doc_id``, eight bits at a time, into lighter units, until they are light or hold one
document each; so a group of copies fills shards one after the other. The units' sizes are one aggregation; their table is
bounded by the ring and by HEAVY, never by the documents, and is all that the driver sees. It walks the ring once, in the
order of a digest of each unit (large ones first), and the table of the units' shards is joined back by broadcast.

``slot`` numbers the rows of a shard from 0 without gaps: units follow each other in a shard, with offsets from their
counts, and only the rows of one unit are numbered together. Size is the UTF-8 bytes of the text, plus 1; a null text has
none. Rows equal in ``doc_id`` and text are never told apart: they lie in one unit, in any order. Columns that the result
adds replace the caller's of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.storage import stored

RING = 1 << 16
VIRTUAL = 128
SLACK = 0.01
HEAVY = 0.002
SEED = "ring-1"
CUT = 2  # hex digits that cut a heavy unit
WIDEST = 32  # hex digits of a document's digest
ADDED = ["size", "shard", "slot"]


def ring(n_shards: int, virtual: int = VIRTUAL, seed: str = SEED) -> list[tuple[int, int]]:
    """Sorted (place, shard) of the virtual nodes; where two meet, the smaller shard stands."""
    nodes: dict[int, int] = {}
    for shard in range(n_shards):
        for i in range(virtual):
            nodes.setdefault(int(hashlib.md5(f"{seed}:{shard}:{i}".encode()).hexdigest()[:4], 16), shard)
    return sorted(nodes.items())


def deal(units: list[tuple[str, int]], n_shards: int, slack: float = SLACK, virtual: int = VIRTUAL, seed: str = SEED) -> dict[str, int]:
    """The shard of each (unit, size). A unit is four hex digits of its place and those of its cuts.

    A unit that fits nowhere goes to the emptiest shard, so that all are placed.
    """
    nodes = ring(n_shards, virtual, seed)
    places = [p for p, _ in nodes]
    most = (1 + slack) * sum(size for _, size in units) / n_shards
    load = [0] * n_shards
    out: dict[str, int] = {}
    large = HEAVY * most

    def turn(unit: tuple[str, int]) -> tuple:
        """Units that would not fit in any gap come first, the largest before; the others in the order of a digest."""
        return (unit[1] <= large, -unit[1] * (unit[1] > large), hashlib.md5(f"{seed}|{unit[0]}".encode()).digest())

    for unit, size in sorted(units, key=turn):
        at = bisect_left(places, int(unit[:4], 16))
        met: list[int] = []
        for step in range(len(nodes)):
            shard = nodes[(at + step) % len(nodes)][1]
            if shard not in met:
                met.append(shard)
                if load[shard] + size <= most:
                    break
        else:
            shard = min(range(n_shards), key=lambda s: (load[s], s))
        load[shard] += size
        out[unit] = shard
    return out


def units_of(keyed: DataFrame, n_shards: int, heavy: float = HEAVY) -> dict[str, tuple[int, int]]:
    """size and rows of every unit of rows with ``place``, ``own`` (hex digits) and ``size``."""
    summed = lambda df, unit: {r["u"]: (r["s"], r["n"]) for r in df.groupBy(unit.alias("u")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    out = summed(keyed, F.col("place"))
    bound = heavy * sum(s for s, _ in out.values()) / n_shards
    width = 0
    while width < WIDEST:
        large = [u for u, (s, n) in out.items() if s > bound and n > 1 and len(u) == 4 + width]
        if not large:
            break
        table = keyed.sparkSession.createDataFrame([(u,) for u in large], "u string")
        now = F.concat("place", F.substring("own", 1, width))
        rows = keyed.join(F.broadcast(table), now == F.col("u"), "left_semi")
        width += CUT
        for u in large:
            del out[u]
        out |= summed(rows, F.concat("place", F.substring("own", 1, width)))
    return out


def assign(docs: DataFrame, n_shards: int, slack: float = SLACK, text: str = "text", doc_id: str = "doc_id", digest: str | None = None, size: str | None = None) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``. A caller that has dropped the texts names columns of digest (MD5, in
    hex) and size instead."""
    given = F.col(text) if digest is None else None
    named = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    sized = (F.coalesce(F.octet_length(given), F.lit(0)) + 1) if size is None else F.col(size)
    hashed = F.md5(F.coalesce(given, F.lit("")).cast("binary")) if digest is None else F.col(digest)
    rows = docs.withColumns({"_s_size": sized.cast("long"), "_s_place": F.substring(hashed, 1, 4), "_s_own": F.md5(named.cast("binary")), "_s_text": hashed})
    slim = rows.select(F.col("_s_place").alias("place"), F.col("_s_own").alias("own"), F.col("_s_size").alias("size"))
    units = units_of(slim, n_shards)
    shards = deal([(u, s) for u, (s, _) in units.items()], n_shards, slack)
    at = [0] * n_shards
    table = []
    for unit in sorted(units):
        shard, n = shards[unit], units[unit][1]
        table.append((unit, shard, at[shard]))
        at[shard] += n
    spark = docs.sparkSession
    known = spark.createDataFrame(table, "_s_unit string, _s_shard int, _s_before long")
    joined = rows.withColumns({"_s_unit": F.lit(None).cast("string"), "_s_shard": F.lit(None).cast("int"), "_s_before": F.lit(None).cast("long")})
    for width in sorted({len(u) for u in units}):  # units are found by an equi-join on as many digits as they have
        own = F.broadcast(known.filter(F.length("_s_unit") == width).toDF("_s_u", "_s_s", "_s_b"))
        key = F.concat("_s_place", F.substring("_s_own", 1, width - 4))
        found = joined.join(own, key == F.col("_s_u"), "left")
        new = {"_s_unit": F.coalesce("_s_unit", "_s_u"), "_s_shard": F.coalesce("_s_shard", "_s_s"), "_s_before": F.coalesce("_s_before", "_s_b")}
        joined = found.withColumns(new).drop("_s_u", "_s_s", "_s_b")
    within = Window.partitionBy("_s_unit").orderBy(F.col(doc_id).asc_nulls_first(), "_s_text")
    numbered = joined.withColumn("_s_slot", F.col("_s_before") + F.row_number().over(within) - 1)
    kept = [c for c in docs.columns if c not in ADDED]
    return numbered.select(*(F.col(f"`{c}`") for c in kept), F.col("_s_size").alias("size"), F.col("_s_shard").alias("shard"), F.col("_s_slot").alias("slot"))


def slim_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """What ``assign`` needs of each document, read once and stored: id, size, CRC-32 and digest of the text."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("n_bytes"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("digest")
        )
    )
