"""Marts that take in new orders without a rebuild.

A mart is kept as mergeable partial states: sums of money in two halves of whole cents, counts, and the distinct customers
as rows or, where a group has many, as bitmaps. A batch of orders adds states of its own, in a folder per month and batch,
and the mart is made anew for the months that the batch touches, from all batches of those months. So late orders only
cost their month, nothing else is read or written, and a batch that runs twice replaces itself.

States move once, to slots of their month, so a month's states of a batch make one file per slot. Those of a month that only
one batch has are merged already, and its mart is one aggregation over the files.

An order belongs to one batch; a batch that changes must keep its months. ``compact`` merges the states of a month.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallywork.functions.numbers import exact_sum, ratio
from tallywork.operators import orderfacts as of
from tallywork.plans import marts
from tallywork.session import materialise

#: Facts of a batch for each slot of its months: what one task gets at most, were they all of one month.
FACTS_PER_SLOT = 5_000_000
SUMS = ("orders", "quantity", "revenue_hi", "revenue_lo", "gross_profit_hi", "gross_profit_lo", "revenue_rows", "margin_sum", "margin_rows")
MONTH, BATCH, SLOT = "part", "batch", "slot"


@dataclass(frozen=True)
class MartState:
    """A mart as states: its keys, the date that tells the month, and its columns over sums and the number of customers.

    ``dense``: customers as bitmaps of 4 KB per group and 32,768 customer numbers, for groups of many; else as rows.
    """

    name: str
    keys: tuple[str, ...]
    date: str
    dense: bool
    columns: Callable[[Column], Sequence[Column]]

    @property
    def member(self) -> str:
        return "bucket" if self.dense else "customer_id"


def _orders() -> Column:
    return F.sum("orders")


DAILY = MartState("fct_revenue_daily", marts.DAILY_KEYS, "order_date", False, lambda customers: [
    _orders().alias("order_count"), customers.alias("customer_count"), of.quantity().alias("total_quantity"),
    of.revenue().alias("total_revenue"), of.profit().alias("total_profit"), of.mean_line_revenue().alias("avg_order_value"),
    of.mean_margin().alias("avg_profit_margin"),
])
MONTHLY = MartState("fct_kpis_monthly", marts.MONTHLY_KEYS, "order_month", True, lambda customers: [
    _orders().alias("order_count"), customers.alias("customer_count"), of.revenue().alias("revenue"), of.profit().alias("gross_profit"),
    ratio(exact_sum("revenue"), _orders()).alias("aov"), ratio(exact_sum("revenue"), customers).alias("revenue_per_customer"),
    of.mean_margin().alias("avg_profit_margin"),
])


def _to_slots(rows: DataFrame, mart: MartState, slots: int) -> DataFrame:
    """``rows`` with what belongs to one state in one task: months, and ``slots`` parts of each, stay together."""
    slot = F.pmod(F.xxhash64(*mart.keys, mart.member), F.lit(slots)).alias(SLOT)
    return rows.select("*", slot).repartition(MONTH, SLOT)


def partial_states(facts: DataFrame, mart: MartState, slots: int = 1) -> DataFrame:
    """States of ``facts`` (order facts at the mart's keys): part, keys, members, sums."""
    month = F.coalesce(F.year(mart.date) * 100 + F.month(mart.date), F.lit(0)).alias(MONTH)
    added = [F.count("order_id").alias("orders"), *[F.sum(c).alias(c) for c in SUMS[1:] if c in facts.columns]]
    if not mart.dense:
        # An order is hardly met by another one of its customer and day: nothing to add up before the rows move.
        placed = _to_slots(facts.select("*", month), mart, slots)
        return placed.groupBy(MONTH, SLOT, *mart.keys, "customer_id").agg(*added).drop(SLOT)
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col("customer_id"))).alias("bits")
    return facts.groupBy(month, *mart.keys, F.bitmap_bucket_number(F.col("customer_id")).alias("bucket")).agg(bits, *added)


def merged_states(states: DataFrame, mart: MartState, slots: int = 0) -> DataFrame:
    """States of several batches as those of one, by slots if there are any."""
    added = [F.sum(c).alias(c) for c in SUMS if c in states.columns]
    bits = [F.bitmap_or_agg("bits").alias("bits")] if mart.dense else []
    if not slots:
        return states.groupBy(MONTH, *mart.keys, mart.member).agg(*bits, *added)
    return _to_slots(states, mart, slots).groupBy(MONTH, SLOT, *mart.keys, mart.member).agg(*bits, *added).drop(SLOT)


def _rows_of(merged: DataFrame, mart: MartState) -> DataFrame:
    """The mart's rows, with their part, from states that are merged."""
    customers = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)) if mart.dense else F.count("customer_id")
    return merged.groupBy(MONTH, *mart.keys).agg(*mart.columns(customers))


def mart_of(states: DataFrame, mart: MartState, slots: int = 0) -> DataFrame:
    """The mart's rows, with their part, from states of any number of batches."""
    return _rows_of(merged_states(states, mart, slots), mart)


def _paths(folder: str, mart: MartState) -> tuple[str, str]:
    return os.path.join(folder, f"{mart.name}_states"), os.path.join(folder, mart.name)


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that ``df`` has rows of, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _states_of(spark: SparkSession, folder: str, mart: MartState, months: Sequence[int]) -> DataFrame:
    """All batches' states of some months; the filter prunes the other folders."""
    return spark.read.parquet(_paths(folder, mart)[0]).filter(F.col(MONTH).isin([int(m) for m in months]))


def _made(states: DataFrame, mart: MartState) -> DataFrame:
    """``mart_of`` the stored states; months of a single batch need no merging."""
    months = states.groupBy(MONTH, BATCH).count().groupBy(MONTH).agg(F.count("*").alias("batches"), F.sum("count").alias("n")).collect()
    several = [r for r in months if r["batches"] > 1]
    shared = F.col(MONTH).isin([r[MONTH] for r in several])
    slots = 0 if mart.dense else sum(r["n"] for r in several) // FACTS_PER_SLOT + 1
    return _rows_of(states.filter(~shared), mart).union(mart_of(states.filter(shared), mart, slots))


def add_batch(folder: str, mart: MartState, facts: DataFrame, batch: str, n_facts: int = 0) -> list[int]:
    """Takes in a batch of order facts and makes the months that it touches anew; returns them (0: without a date).

    ``n_facts``: about how many facts there are; a month of a large batch is spread over several tasks.
    """
    spark = facts.sparkSession
    states, rows = _paths(folder, mart)
    touched = Observation()
    own = partial_states(facts, mart, n_facts // FACTS_PER_SLOT + 1).observe(touched, F.collect_set(MONTH).alias("months"))
    _replace(own.withColumn(BATCH, F.lit(batch)), states, MONTH, BATCH)
    months = sorted(touched.get["months"])
    if months:
        # Few rows per month by now: a file or so each.
        _replace(_made(_states_of(spark, folder, mart, months), mart).hint("rebalance", MONTH), rows, MONTH)
    return months


def read_mart(spark: SparkSession, folder: str, mart: MartState) -> DataFrame:
    return spark.read.parquet(_paths(folder, mart)[1]).drop(MONTH)


def compact(spark: SparkSession, folder: str, mart: MartState, months: Sequence[int], into: str) -> None:
    """The states of ``months`` as one batch ``into``, for marts with many batches per month; the mart stays as it is.

    The merged states are durable before the folders of the others go, and those go one month at a time.
    """
    states = _paths(folder, mart)[0]
    for month in months:
        merged = materialise(merged_states(_states_of(spark, folder, mart, [month]), mart))
        merged.withColumn(BATCH, F.lit(into)).drop(MONTH).write.mode("overwrite").partitionBy(BATCH).parquet(os.path.join(states, f"{MONTH}={month}"))
