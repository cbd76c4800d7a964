"""Dashboard reports: KPI cards, trends, top lists and the Pareto share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.functions.numbers import exact_sum, ratio, total
from tallywork.operators import orderfacts as of
from tallywork.operators.globalorder import running_total

# The selectable windows in days, None for all time, which is shown as ALL_TIME days.
WINDOWS = (7, 30, 90, None)
ALL_TIME = 10000
TREND_DAYS = 90


def kpi_cards(orders: DataFrame, as_of: dt.date, windows: Sequence[int | None] = WINDOWS) -> DataFrame:
    """Headline figures per window, all windows in one pass over the orders.

    ``orders``: order facts with ``order_date``. An order belongs to the narrowest window that reaches back to it,
    and a customer to that of the latest order; wider windows add these parts up. So no row is repeated, and
    customers are counted without a distinct. A window without orders has no row.
    """
    age = F.datediff(F.lit(as_of), F.col("order_date"))
    ordered = sorted(windows, key=lambda w: (w is None, w))
    step = F.coalesce(*[F.when(age <= w, F.lit(i)) if w is not None else F.lit(i) for i, w in enumerate(ordered)])
    sums = ("revenue_hi", "revenue_lo", "gross_profit_hi", "gross_profit_lo", "margin_sum", "margin_rows")
    per_customer = orders.select("*", step.alias("step")).filter("step is not null").groupBy("customer_id", "step").agg(
        F.count("order_id").alias("orders"), *[F.sum(c).alias(c) for c in sums]
    )
    latest = per_customer.groupBy("customer_id").agg(
        F.min("step").alias("first"),
        F.collect_list(F.struct("step", "orders", *sums)).alias("parts"),  # one per window at most
    )
    parts = latest.select(
        (F.col("customer_id").isNotNull()).cast("int").alias("known"), "first", F.explode("parts").alias("p")
    ).select(
        F.when(F.col("p.step") == F.col("first"), F.col("known")).otherwise(F.lit(0)).alias("customers"), "p.*"
    ).groupBy("step").agg(F.sum("customers").alias("customers"), F.sum("orders").alias("orders"), *[F.sum(c).alias(c) for c in sums])
    shown = F.array(*[F.struct(F.lit(i).alias("upto"), F.lit(ALL_TIME if w is None else w).alias("days")) for i, w in enumerate(ordered)])
    reached = parts.select("*", F.explode(F.filter(shown, lambda w: w["upto"] >= F.col("step"))).alias("w"))
    return (
        reached.groupBy(F.col("w.days").alias("days"))
        .agg(
            of.revenue().alias("total_revenue"),
            F.sum("orders").alias("total_orders"),
            F.sum("customers").alias("total_customers"),
            of.revenue_per(F.sum("orders")).alias("aov"),
            of.profit().alias("total_profit"),
            of.mean_margin().alias("avg_margin"),
        )
    )


def trend_daily(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("order_date")
        .agg(of.revenue().alias("revenue"), of.order_count().alias("orders"), of.profit().alias("profit"))
        .orderBy("order_date")
    )


def trend_daily_summary(orders: DataFrame) -> DataFrame:
    """Mean revenue per day with orders, and the window's totals."""
    daily = orders.groupBy("order_date").agg(
        exact_sum("revenue").alias("revenue"),
        F.count("order_id").alias("orders"),
        exact_sum("gross_profit").alias("profit"),
    )
    return daily.agg(
        ratio(F.sum("revenue"), F.count("revenue")).alias("avg_daily_revenue"),
        F.sum("orders").alias("total_orders"),
        total(F.col("profit")).alias("total_profit"),
    )


def trend_monthly(orders: DataFrame) -> DataFrame:
    """``orders``: order facts at ``["order_month"]``."""
    return (
        orders.groupBy("order_month")
        .agg(
            of.revenue().alias("revenue"),
            of.order_count().alias("orders"),
            of.customer_count().alias("customers"),
            of.profit().alias("profit"),
            of.mean_margin().alias("avg_margin"),
        )
        .orderBy("order_month")
    )


def period_change(series: DataFrame, period: str, value: str) -> DataFrame:
    """Percent change of each period over the one before (NULL for the first).

    For a series of calendar periods: its length is bounded by the calendar, so the
    ordered window is small however large the facts are.
    """
    previous = F.lag(value).over(Window.orderBy(period))
    return series.select(
        period, value, previous.alias("previous"),
        (ratio(F.col(value) - previous, previous) * 100).alias("growth_pct"),
    )


def mom_growth(monthly: DataFrame) -> DataFrame:
    """The latest month against the one before; no row with fewer than two months."""
    changes = period_change(monthly.select("order_month", "revenue"), "order_month", "revenue")
    return changes.orderBy(F.col("order_month").desc()).limit(1).filter(F.col("previous").isNotNull())


def top_products(orders: DataFrame, n: int = 15) -> DataFrame:
    """``orders``: order facts at ``["product_name"]``. They collapse to one row per product and customer, so that counting
    customers is a plain count and the facts are planned once."""
    parts = ("quantity", "revenue_hi", "revenue_lo", "gross_profit_hi", "gross_profit_lo", "margin_sum", "margin_rows")
    bought = orders.groupBy("product_name", "customer_id").agg(*[F.sum(c).alias(c) for c in parts])
    return (
        bought.groupBy("product_name")
        .agg(
            of.revenue().alias("total_revenue"),
            of.quantity().alias("total_quantity"),
            of.profit().alias("total_profit"),
            of.mean_margin().alias("avg_margin"),
            F.count("customer_id").alias("unique_customers"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_last(), F.col("product_name"))
        .limit(n)
    )


def top_customers(orders: DataFrame, names: DataFrame, n: int = 20) -> DataFrame:
    """Totals per customer first, then their names, then grouped by name as displayed."""
    per_customer = orders.groupBy("customer_id").agg(
        exact_sum("revenue").alias("revenue"),
        F.count("order_id").alias("orders"),
        exact_sum("gross_profit").alias("profit"),
    )
    return (
        per_customer.join(names, "customer_id", "left")
        .groupBy("customer_name")
        .agg(
            total(F.col("revenue")).alias("total_revenue"),
            F.sum("orders").alias("total_orders"),
            ratio(F.sum("revenue"), F.sum("orders")).alias("avg_order_value"),
            total(F.col("profit")).alias("total_profit"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_last(), "customer_name")
        .limit(n)
    )


def cumulative_share(entities: DataFrame, key: str, value: str) -> DataFrame:
    """Running share of the total (in percent), largest value first.

    ``value`` is fixed point, so the running sum is exact in any partitioning.
    """
    ranked = running_total(entities, [F.col(value).desc_nulls_last(), F.col(key)], F.col(value), "cumulative")
    # from the ranked table, whose rows are already stored
    overall = ranked.agg(F.sum(value).cast("double").alias("overall"))
    share = ratio(F.col("cumulative"), overall.scalar()) * 100
    return ranked.withColumn("cumulative_pct", share)


def pareto_share(shares: DataFrame, threshold: float = 80.0) -> DataFrame:
    """How many entities fill the first ``threshold`` percent of the total."""
    within: Column = F.count_if(F.col("cumulative_pct") <= threshold)
    return shares.agg(
        F.count(F.lit(1)).alias("entities"),
        within.alias("entities_within"),
        (ratio(within, F.count(F.lit(1))) * 100).alias("pct_within"),
    )
