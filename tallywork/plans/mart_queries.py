"""Mart queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.operators.orderfacts import order_facts
from tallywork.plans import incremental, marts
from tallywork.plans.registry import query
from tallywork.session import new_folder
from tallywork.sources.star import Star

#: Lines whose sums per product and order one task holds.
LINES_PER_TASK = 500_000
FULL = ("quantity", "revenue", "gross_profit", "profit_margin")


@query()
def fact_orders(star: Star) -> DataFrame:
    return marts.fact_orders(star.sales(marts.FACT_COLUMNS))


@query()
def dim_customer(star: Star) -> DataFrame:
    attributes = ["customer_name", "customer_segment", "customer_state"]
    customers = (
        star.customers(attributes)
        .join(star.signups(), "customer_id", "left")
        .withColumnsRenamed({"customer_segment": "segment", "customer_state": "state"})
    )
    return marts.dim_customer(customers, order_facts(star, ["order_date"], ["revenue"]), star.as_of())


@query()
def fct_revenue_daily(star: Star) -> DataFrame:
    return marts.fct_revenue_daily(order_facts(star, marts.DAILY_KEYS, FULL))


@query()
def fct_kpis_monthly(star: Star) -> DataFrame:
    return marts.fct_kpis_monthly(order_facts(star, marts.MONTHLY_KEYS, FULL[1:]))


def _in_two_batches(star: Star, mart: incremental.MartState, measures) -> DataFrame:
    """Even orders, then odd ones, which all come late."""
    folder = new_folder(star.spark, mart.name)
    facts, lines = order_facts(star, mart.keys, measures), star.table("lineitem").count()
    for batch in (0, 1):
        incremental.add_batch(folder, mart, facts.filter(F.col("order_id") % 2 == batch), f"b{batch}", lines // 2)
    return incremental.read_mart(star.spark, folder, mart)


@query()
def incremental_revenue_daily(star: Star) -> DataFrame:
    return _in_two_batches(star, incremental.DAILY, FULL)


@query()
def incremental_kpis_monthly(star: Star) -> DataFrame:
    return _in_two_batches(star, incremental.MONTHLY, FULL[1:])


@query()
def fct_product_performance(star: Star) -> DataFrame:
    # Products hardly recur in an order, so a task holds sums for nearly every line: their number per task has a bound.
    tasks = -(-star.table("lineitem").count() // LINES_PER_TASK) or 1
    lines = star.order_lines(["product_id", "quantity", "price_cents"]).repartition(tasks, "order_id")
    sales = lines.join(star.order_headers(["order_date"]).repartition(tasks, "order_id"), "order_id", "inner")
    return marts.fct_product_performance(star.products(), sales)


@query()
def fct_customer_cohorts(star: Star) -> DataFrame:
    return marts.fct_customer_cohorts(star.signups(), order_facts(star, ["order_month"], ["revenue"]))
