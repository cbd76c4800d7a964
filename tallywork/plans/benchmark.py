"""The ten benchmark questions over sales, each as a DataFrame plan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions.numbers import exact_sum, ratio, summed_parts, total
from tallywork.operators import orderfacts as of
from tallywork.operators.orderfacts import order_facts
from tallywork.plans.registry import query
from tallywork.sources.star import Star


@query()
def revenue_by_region(star: Star) -> DataFrame:
    return (
        order_facts(star, ["region"], ["revenue"])
        .groupBy("region")
        .agg(of.revenue().alias("total_revenue"))
        .orderBy(F.col("total_revenue").desc_nulls_last(), "region")
    )


@query()
def orders_by_segment(star: Star) -> DataFrame:
    """Orders of unknown customers are left out, as by the question's inner join."""
    per_customer = order_facts(star, [], []).groupBy("customer_id").agg(of.order_count().alias("n"))
    return (
        per_customer.join(star.customers(["customer_segment"]), "customer_id", "inner")
        .groupBy("customer_segment").agg(F.sum("n").alias("order_count"))
    )


@query()
def top10_customers(star: Star) -> DataFrame:
    """The ten best among the known customers: totals per customer meet the customers before the limit."""
    totals = order_facts(star, [], ["revenue"]).groupBy("customer_id").agg(of.revenue().alias("revenue"))
    return (
        totals.join(star.customers(["customer_name"]), "customer_id", "inner")
        .select("customer_id", "customer_name", "revenue")
        .orderBy(F.col("revenue").desc_nulls_last(), "customer_id")
        .limit(10)
    )


@query()
def monthly_revenue_year(star: Star, year: int = 2000) -> DataFrame:
    """The year is a range on the raw date, so whole row groups outside it are skipped."""
    since, until = dt.date(year, 1, 1), dt.date(year + 1, 1, 1)
    return (
        order_facts(star, ["order_month"], ["revenue"], since=since, until=until)
        .groupBy("order_month")
        .agg(of.revenue().alias("revenue"))
        .orderBy("order_month")
    )


@query()
def avg_value_by_category(star: Star) -> DataFrame:
    """Lines of unknown products are left out, as by the question's inner join."""
    # No order is counted, so the lines need not collapse to orders: they move once to meet them.
    per_product = star.sales(["product_id", "revenue_cents"]).groupBy("product_id").agg(
        *summed_parts("revenue_cents", "revenue"), F.count("revenue_cents").alias("rows")
    ).groupBy("product_id").agg(exact_sum("revenue").alias("revenue"), F.first("rows").alias("rows"))
    return (
        per_product.join(star.products(["product_category"]), "product_id", "inner")
        .groupBy("product_category").agg(ratio(F.sum("revenue"), F.sum("rows")).alias("avg_order_value"))
    )


@query()
def customers_gt5_orders(star: Star) -> DataFrame:
    """Counts order rows, not distinct orders, as the question's SQL does."""
    counted = (
        order_facts(star, [], [])
        .groupBy("customer_id")
        .agg(F.sum("line_count").alias("order_count"))
        .filter(F.col("order_count") > 5)
    )
    return (
        counted.join(star.customers(["customer_name"]), "customer_id", "inner")
        .select("customer_id", "customer_name", "order_count")
        .orderBy(F.col("order_count").desc(), "customer_id")
    )


@query()
def revenue_per_customer_by_state(star: Star) -> DataFrame:
    per_customer = order_facts(star, [], ["revenue"]).groupBy("customer_id").agg(
        exact_sum("revenue").alias("revenue")
    )
    return (
        per_customer.join(star.customers(["customer_state"]), "customer_id", "inner")
        .groupBy("customer_state")
        .agg(
            F.count("customer_id").alias("customer_count"),
            total(F.col("revenue")).alias("total_revenue"),
            ratio(F.sum("revenue"), F.count("customer_id")).alias("revenue_per_customer"),
        )
        .orderBy(F.col("revenue_per_customer").desc_nulls_last(), "customer_state")
    )


@query()
def never_ordered(star: Star) -> DataFrame:
    sold = star.table("lineitem").select(F.col("l_partkey").alias("product_id")).distinct()
    return star.products(["product_name", "product_category"]).join(sold, "product_id", "left_anti")


@query()
def orders_without_lines(star: Star) -> DataFrame:
    filled = star.table("lineitem").select(F.col("l_orderkey").alias("order_id")).distinct()
    return star.order_headers(["order_date", "customer_id"]).join(filled, "order_id", "left_anti")


@query()
def revenue_by_year(star: Star) -> DataFrame:
    return (
        order_facts(star, ["year"], ["revenue"])
        .groupBy("year")
        .agg(of.revenue().alias("revenue"))
        .orderBy("year")
    )


@query()
def top5_regions_avg_qty(star: Star) -> DataFrame:
    return (
        order_facts(star, ["region"], ["quantity"])
        .groupBy("region")
        .agg(ratio(F.sum("quantity"), F.sum("line_count")).alias("avg_quantity"))
        .orderBy(F.col("avg_quantity").desc_nulls_last(), "region")
        .limit(5)
    )
