"""The six data marts.

``fact_orders`` works on a sales view; the others on order facts (``operators.orderfacts``)
or on per-entity totals, so that no mart joins a dimension before it has aggregated.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions import dates
from tallywork.functions.numbers import decimal_cents, exact_sum, ratio, rounded, summed_parts, total
from tallywork.operators import orderfacts as of

FACT_COLUMNS = (
    "order_id", "order_date", "customer_id", "product_id", "region", "quantity", "price",
    "revenue", "customer_segment", "customer_state", "product_category", "product_cost",
    "gross_profit", "profit_margin", "order_month", "order_quarter", "order_year",
    "year", "quarter", "month", "day_of_week",
)
MONEY_COLUMNS = ("price", "revenue", "product_cost", "gross_profit")


def fact_orders(sales: DataFrame) -> DataFrame:
    """Enriched order lines for delivery: the 21 columns, money as DOUBLE."""
    return sales.select(
        *[F.col(c).cast("double").alias(c) if c in MONEY_COLUMNS else F.col(c) for c in FACT_COLUMNS]
    )


def dim_customer(customers: DataFrame, orders: DataFrame, as_of: dt.date) -> DataFrame:
    """Lifetime metrics per customer; customers without orders keep NULLs and a zero count.

    ``orders``: order facts at ``["order_date"]``. They collapse to one row per customer
    before they meet the dimension.
    """
    lifetime = orders.groupBy("customer_id").agg(
        F.count("order_id").alias("lifetime_orders"),
        of.revenue().alias("lifetime_revenue"),
        of.mean_line_revenue().alias("avg_order_value"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )
    days = F.datediff(F.lit(as_of), F.col("last_order_date")).cast("long")
    return customers.join(lifetime, "customer_id", "left").select(
        *customers.columns,
        F.coalesce("lifetime_orders", F.lit(0)).alias("lifetime_orders"),
        "lifetime_revenue",
        "avg_order_value",
        "first_order_date",
        "last_order_date",
        days.alias("days_since_last_order"),
    )


DAILY_KEYS = ("order_date", "region", "customer_segment", "product_category")


def fct_revenue_daily(orders: DataFrame) -> DataFrame:
    """``orders``: order facts at ``DAILY_KEYS``."""
    return orders.groupBy(*DAILY_KEYS).agg(
        of.order_count().alias("order_count"),
        of.customer_count().alias("customer_count"),
        of.quantity().alias("total_quantity"),
        of.revenue().alias("total_revenue"),
        of.profit().alias("total_profit"),
        of.mean_line_revenue().alias("avg_order_value"),
        of.mean_margin().alias("avg_profit_margin"),
    )


MONTHLY_KEYS = ("order_month", "region")


def fct_kpis_monthly(orders: DataFrame) -> DataFrame:
    """``orders``: order facts at ``MONTHLY_KEYS``. Latest month first."""
    return (
        orders.groupBy(*MONTHLY_KEYS)
        .agg(
            of.order_count().alias("order_count"),
            of.customer_count().alias("customer_count"),
            of.revenue().alias("revenue"),
            of.profit().alias("gross_profit"),
            of.revenue_per(of.order_count()).alias("aov"),
            of.revenue_per(of.customer_count()).alias("revenue_per_customer"),
            of.mean_margin().alias("avg_profit_margin"),
        )
        .orderBy(F.col("order_month").desc_nulls_last(), F.col("region").asc_nulls_last())
    )


def fct_product_performance(products: DataFrame, sales: DataFrame) -> DataFrame:
    """Totals per product, never-sold products included; best revenue first.

    Within one product the cost is a constant c, so profit is Σ revenue − c·Σ quantity and
    a line's margin is 1 − c/price. Sales are therefore summed per product first, and
    only those sums meet the product table: the lines are never shuffled for the cost.
    """
    cents = "price_cents" if "price_cents" in sales.columns else decimal_cents("price")
    revenue = F.expr("quantity * cents")
    orders = sales.withColumn("cents", F.expr(cents)).groupBy("product_id", "order_id").agg(
        F.sum("quantity").alias("quantity"),
        *summed_parts("quantity * cents", "revenue"),
        F.count_if(revenue != 0).alias("margin_rows"),
        F.sum(F.when(revenue != 0, 100 / F.col("cents").cast("double"))).alias("inverse_price"),
        F.min("order_date").alias("first_date"),
        F.max("order_date").alias("last_date"),
    )
    sums = orders.groupBy("product_id").agg(
        F.count("order_id").alias("order_count"),
        F.sum("quantity").cast("long").alias("total_quantity_sold"),
        exact_sum("revenue").alias("revenue"),
        F.sum("margin_rows").alias("margin_rows"),
        F.sum("inverse_price").alias("inverse_price"),
        F.min("first_date").alias("first_sale_date"),
        F.max("last_date").alias("last_sale_date"),
    )
    cost = F.col("product_cost")
    profit = F.col("revenue") - cost * F.col("total_quantity_sold")
    margin = 1 - cost.cast("double") * ratio(F.col("inverse_price"), F.col("margin_rows"))
    return (
        products.join(sums, "product_id", "left")
        .select(
            "product_id",
            "product_name",
            F.col("product_category").alias("category"),
            F.coalesce("order_count", F.lit(0)).alias("order_count"),
            "total_quantity_sold",
            F.col("revenue").cast("double").alias("total_revenue"),
            profit.cast("double").alias("total_profit"),
            rounded(margin).alias("avg_profit_margin"),
            "first_sale_date",
            "last_sale_date",
        )
        .orderBy(F.col("total_revenue").desc_nulls_last(), "product_id")
    )


def fct_customer_cohorts(signups: DataFrame, orders: DataFrame) -> DataFrame:
    """Signup month × order month. ``orders``: order facts at ``["order_month"]``.

    A customer's orders collapse to one row per month before the signup month joins in.
    Months are negative for orders placed before the signup.
    """
    monthly = orders.groupBy("customer_id", "order_month").agg(
        F.count("order_id").alias("orders"), exact_sum("revenue").alias("revenue")
    )
    cohort = signups.select("customer_id", dates.month_start(F.col("signup_date")).alias("cohort_month"))
    months = dates.months_between_starts(F.col("cohort_month"), F.col("order_month"))
    return (
        monthly.filter(F.col("order_month").isNotNull())
        .join(cohort, "customer_id", "inner")
        .groupBy("cohort_month", "order_month")
        .agg(
            # one row per customer and month reaches this group
            F.count("customer_id").alias("customer_count"),
            F.sum("orders").alias("order_count"),
            total(F.col("revenue")).alias("revenue"),
        )
        .select(
            "cohort_month", "order_month", months.alias("months_since_signup"),
            "customer_count", "order_count", "revenue",
        )
        .orderBy("cohort_month", "order_month")
    )
