"""First-wins, best-wins and ranking without putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.operators.sizing import broadcast_if_small
from docsift.operators.storage import stored

# Rows of one (group, order) are sorted in blocks of this many positions.
POS_BLOCK_BITS = 20
# Offsets of blocks are summed in spans of this many blocks; a span holds a thousand pages.
SPAN_BITS = 20


def first_by(df: DataFrame, keys: list[str], order: list[str], last: bool = False, **extra: Column) -> DataFrame:
    """The row of each key group that comes first (or last) in the given order.

    An aggregate, not a window: partial results are merged on the map side, so a
    key that holds a large share of the rows never gathers in one task.  Every
    ``extra`` aggregate is added as a column.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = pick(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_best")
    out = df.groupBy(*keys).agg(best, *[c.alias(name) for name, c in extra.items()])
    return out.select(
        *[F.col(f"`{k}`") for k in keys],
        *[F.col("_best").getField(c).alias(c) for c in rest],
        *extra,
    )


def add_rank(
    df: DataFrame,
    by: list[str],
    order: list[str],
    pos: str,
    limit: int | None = None,
    block_bits: int = POS_BLOCK_BITS,
    reread: bool = False,
) -> DataFrame:
    """Number the rows of each ``by`` group 1, 2, ... by ``order`` and then ``pos``.

    ``pos`` must be unique within (by, order).  With a limit Spark keeps at most
    that many rows per group and map task (WindowGroupLimit).  Without one, the
    group is cut at the values of ``order`` and at blocks of ``pos``: counts per
    block give each block its offset, and only a block is ever sorted in one
    task.  Block borders depend on the values alone, so a retried task gets the
    same ranks.

    ``reread`` says that ``df`` is cheap to read twice, like a stored relation: the
    offsets are then stored and, while they measure small, numbered and broadcast,
    so that rows move with one number instead of the columns that it stands for.
    """
    if limit is not None:
        window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order, pos)
        return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)

    # Keys that cannot be NULL: Spark then adds no filter to one of the two uses of
    # ``df`` and runs its last shuffle once for both.
    cells = {f"_c{i}": F.coalesce(c, _never_null(df, c)) for i, c in enumerate(by + order)}
    cells["_block"] = F.coalesce(F.shiftright(F.col(pos).cast("long"), block_bits), F.lit(0).cast("long"))
    keys = list(cells)
    cut = df.withColumns(cells)

    def sum_before(partition: list[str], order_by: list[str]) -> Column:
        window = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    # Blocks can be many (one for each page), so their offsets are summed in two levels: over spans of blocks, which
    # alone meet in one task, and over the blocks inside each span.
    wide = [*keys[:-1], "_span"]
    blocks = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_span", F.shiftright("_block", SPAN_BITS))
    spans = blocks.groupBy(*wide).agg(F.sum("_n").alias("_n"))
    spans = spans.select(*wide, sum_before(wide[: len(by)], wide[len(by) :]).alias("_before_span"))
    offsets = blocks.withColumn("_before_block", sum_before(wide, ["_block"])).join(spans, wide)
    offsets = offsets.select(*keys, (F.col("_before_span") + F.col("_before_block")).alias("_before"))
    cell = keys
    if reread:
        offsets, few = broadcast_if_small(stored(offsets.withColumn("_cell", F.monotonically_increasing_id())))
        cell = ["_cell"] if few else keys
    inside = Window.partitionBy(*cell).orderBy(pos)
    return (
        cut.join(offsets, keys)
        .withColumn("rank", (F.col("_before") + F.row_number().over(inside)).cast("int"))
        .drop("_before", "_cell", *keys)
    )


def _never_null(df: DataFrame, column: str) -> Column:
    zero = "" if df.schema[column].dataType.simpleString() == "string" else 0
    return F.lit(zero).cast(df.schema[column].dataType)
