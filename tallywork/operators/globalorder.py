"""Running totals and positions over a globally ordered table, without one big window.

An ``OVER (ORDER BY …)`` window without partition keys moves the whole table into one
task, and one with keys moves a hot group into one. Here the table is range-partitioned
on group and order, so that even a single group spreads over many partitions. Each
partition totals its own part; what earlier partitions hold of the same group is added as
a carry. A partition can continue at most one group, so the carry has at most one row per
partition and its broadcast is bounded by the number of partitions.

Both passes must see the same row placement, hence the reliable checkpoint in between.
The order must be total (end it with a unique key): tied rows could not be spread.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallywork.session import materialise

PLACE = "__place"


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    values: Mapping[str, Column],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """``df`` plus, for each ``name: value``, the sum of ``value`` from its group's first row on."""
    groups = [F.col(c) for c in partition_by]
    placed = materialise(
        df.repartitionByRange(*groups, *order_by).withColumn(PLACE, F.spark_partition_id())
    )
    parts = placed.groupBy(PLACE, *partition_by).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    before = Window.partitionBy(*partition_by).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        F.col(PLACE), *groups,
        F.lag(F.lit(True)).over(Window.partitionBy(*partition_by).orderBy(PLACE)).alias("__continues"),
        *[F.sum(n).over(before).alias(n) for n in values],
    ).filter("__continues")
    within = (
        Window.partitionBy(PLACE, *partition_by)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = placed.select("*", *[F.sum(v).over(within).alias(n) for n, v in values.items()]).alias("l")
    same = [F.col(f"l.{PLACE}") == F.col(f"c.{PLACE}")]
    same += [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in partition_by]
    joined = local.join(F.broadcast(carry.alias("c")), reduce(Column.__and__, same), "left")
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in df.columns],
        *[(F.col(f"l.{n}") + F.coalesce(F.col(f"c.{n}"), F.lit(0))).alias(n) for n in values],
    )


def running_total(
    df: DataFrame, order_by: Sequence[Column], value: Column, out: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    return running_totals(df, order_by, {out: value}, partition_by)


def with_position(
    df: DataFrame, order_by: Sequence[Column], out: str = "position", partition_by: Sequence[str] = ()
) -> DataFrame:
    """``df`` plus its 1-based place in the global (or per-group) order."""
    return running_total(df, order_by, F.lit(1).cast("long"), out, partition_by)


def with_previous(
    df: DataFrame, order_by: Sequence[Column], columns: Sequence[str], out: str = "previous", partition_by: Sequence[str] = ()
) -> DataFrame:
    """``df`` plus a struct of ``columns`` of the row before in its group; null for a group's first row.

    Within a range partition that is a plain lag. The first row of a group in a partition takes the group's last row of the
    partitions before, the carry.
    """
    groups = [F.col(c) for c in partition_by]
    placed = materialise(
        df.repartitionByRange(*groups, *order_by).withColumn(PLACE, F.spark_partition_id())
    )
    row = F.struct(*columns)
    within = Window.partitionBy(PLACE, *partition_by).orderBy(*order_by)
    local = placed.select("*", F.lag(row).over(within).alias(out), F.row_number().over(within).alias("__nth")).alias("l")
    # One row per partition and group: its last one.
    ends = placed.select(
        PLACE, *groups, row.alias(out), F.row_number().over(Window.partitionBy(PLACE, *partition_by).orderBy(*[_reverse(c) for c in order_by])).alias("__nth")
    ).filter("__nth = 1").drop("__nth")
    by_place = Window.partitionBy(*partition_by).orderBy(PLACE)
    carry = ends.select(PLACE, *groups, F.lag(out).over(by_place).alias("__carried")).filter("__carried is not null").alias("c")
    same = [F.col(f"l.{PLACE}") == F.col(f"c.{PLACE}")]
    same += [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in partition_by]
    joined = local.join(F.broadcast(carry), reduce(Column.__and__, same), "left")
    first = F.col("l.__nth") == 1
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in df.columns],
        F.when(first, F.col("c.__carried")).otherwise(F.col(f"l.{out}")).alias(out),
    )


def _reverse(column: Column) -> Column:
    """The opposite order of a column that is not marked as descending."""
    return column.desc_nulls_last()


BLOCK_ROWS = 65536


def over_rows_before(
    df: DataFrame,
    order_by: Sequence[Column],
    rows: int,
    values: Mapping[str, Callable[[WindowSpec], Column]],
    partition_by: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """``df`` plus, for each ``name: value``, the value over the ``rows`` rows before the current one in its group.

    A group is cut into blocks of positions. Each block also gets the last ``rows`` rows of the one before it, its halo, so
    that every frame lies within one block; halo rows serve as neighbours only. No task holds more of a group than a block.
    """
    size = max(rows, block_rows or BLOCK_ROWS)
    placed = with_position(df, order_by, "__position", partition_by)
    at = F.col("__position") - 1
    block = F.floor(at / size)
    own, next_one = (F.struct(b.alias("block"), F.lit(halo).alias("halo")) for b, halo in ((block, False), (block + 1, True)))
    spread = placed.withColumn("__in", F.explode(F.when(at % size >= size - rows, F.array(own, next_one)).otherwise(F.array(own))))
    frame = Window.partitionBy(*partition_by, "__in.block").orderBy("__position").rowsBetween(-rows, -1)
    return (
        spread.select("*", *[value(frame).alias(name) for name, value in values.items()])
        .filter(~F.col("__in.halo")).select(*df.columns, *values)
    )
