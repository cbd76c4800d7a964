"""Dashboard, anomaly and insight queries over the star schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions.dates import window_start
from tallywork.functions.numbers import exact_sum, rounded
from tallywork.operators import anomaly
from tallywork.operators import orderfacts as of
from tallywork.operators.orderfacts import order_facts
from tallywork.plans import dashboard
from tallywork.plans.registry import query
from tallywork.session import materialise
from tallywork.sources.star import Star

def _window(star: Star, days: int) -> dt.date:
    return window_start(star.as_of(), days)


@query()
def kpi_cards(star: Star) -> DataFrame:
    orders = order_facts(star, ["order_date"], ["revenue", "gross_profit", "profit_margin"])
    return dashboard.kpi_cards(orders, star.as_of())


def _recent(star: Star) -> DataFrame:
    since = _window(star, dashboard.TREND_DAYS)
    return order_facts(star, ["order_date"], ["revenue", "gross_profit"], since=since)


@query()
def trend_daily(star: Star) -> DataFrame:
    return dashboard.trend_daily(_recent(star))


@query()
def trend_daily_summary(star: Star) -> DataFrame:
    return dashboard.trend_daily_summary(_recent(star))


@query()
def trend_monthly(star: Star) -> DataFrame:
    return dashboard.trend_monthly(
        order_facts(star, ["order_month"], ["revenue", "gross_profit", "profit_margin"])
    )


def _monthly_revenue(star: Star) -> DataFrame:
    orders = order_facts(star, ["order_month"], ["revenue"])
    return orders.groupBy("order_month").agg(of.revenue().alias("revenue"))


@query()
def mom_growth(star: Star) -> DataFrame:
    return dashboard.mom_growth(_monthly_revenue(star))


@query()
def mom_growth_series(star: Star) -> DataFrame:
    return dashboard.period_change(_monthly_revenue(star), "order_month", "revenue")


@query()
def top_products(star: Star) -> DataFrame:
    return dashboard.top_products(
        order_facts(star, ["product_name"], ["quantity", "revenue", "gross_profit", "profit_margin"])
    )


def _customer_orders(star: Star, measures=("revenue", "gross_profit")) -> DataFrame:
    return order_facts(star, [], measures)


@query()
def top_customers(star: Star) -> DataFrame:
    return dashboard.top_customers(_customer_orders(star), star.customers(["customer_name"]))


def _customer_revenue(star: Star) -> DataFrame:
    return _customer_orders(star, ["revenue"]).groupBy("customer_id").agg(exact_sum("revenue").alias("revenue"))


@query()
def pareto_80_20(star: Star) -> DataFrame:
    """Share within the displayed top 20 customers."""
    best = _customer_revenue(star).orderBy(F.col("revenue").desc_nulls_last(), "customer_id").limit(20)
    return dashboard.pareto_share(dashboard.cumulative_share(best, "customer_id", "revenue"))


@query()
def pareto_80_20_all(star: Star) -> DataFrame:
    """Share among all customers."""
    return dashboard.pareto_share(
        dashboard.cumulative_share(_customer_revenue(star), "customer_id", "revenue")
    )


@query()
def pareto_curve(star: Star) -> DataFrame:
    curve = dashboard.cumulative_share(_customer_revenue(star), "customer_id", "revenue")
    return curve.select(
        "customer_id", F.col("revenue").cast("double").alias("revenue"),
        F.col("cumulative").cast("double").alias("cumulative_revenue"), "cumulative_pct",
    )


def _daily(star: Star, days: int | None) -> DataFrame:
    """Daily metrics (``days`` None: all), computed once: the scoring below reads them several times."""
    since = None if days is None else _window(star, days)
    return materialise(
        order_facts(star, ["order_date"], ["revenue"], since=since).groupBy("order_date").agg(
            of.revenue().alias("daily_revenue"),
            of.order_count().alias("daily_orders"),
            of.mean_line_revenue().alias("avg_order_value"),
        )
    )


@query()
def daily_metrics_with_z(star: Star) -> DataFrame:
    daily = _daily(star, dashboard.TREND_DAYS)
    return anomaly.with_zscore(daily, "daily_revenue", min_rows=11).select(
        *daily.columns,
        rounded(F.col("zscore")).alias("revenue_zscore"),
        (F.abs("zscore") > 2).alias("is_anomaly"),
    )


def _revenue_anomalies(daily: DataFrame) -> DataFrame:
    return anomaly.zscore_anomalies(daily, "daily_revenue", "order_date", "Revenue")


def _order_anomalies(daily: DataFrame) -> DataFrame:
    return anomaly.zscore_anomalies(daily, "daily_orders", "order_date", "Order Count")


def _flat(anomalies: DataFrame) -> DataFrame:
    return anomalies.select(
        "metric_name", "date", "value",
        F.col("expected_range.lo").alias("expected_lo"), F.col("expected_range.hi").alias("expected_hi"),
        "severity", "description",
    )


@query()
def zscore_anomalies(star: Star) -> DataFrame:
    """Full history of daily order totals."""
    daily = materialise(
        star.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("order_date")).agg(
            F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("daily_total")
        )
    )
    return _flat(anomaly.zscore_anomalies(daily, "daily_total", "order_date", "Order Total"))


@query()
def revenue_anomalies(star: Star) -> DataFrame:
    return _flat(_revenue_anomalies(_daily(star, 90)))


@query()
def order_anomalies(star: Star) -> DataFrame:
    return _flat(_order_anomalies(_daily(star, 90)))


@query()
def rolling_anomalies(star: Star) -> DataFrame:
    """Daily revenue per region, segment and category: days far off the thirty sales days before."""
    groups = ["region", "customer_segment", "product_category"]
    daily = order_facts(star, ["order_date", *groups], ["revenue"]).groupBy("order_date", *groups).agg(
        (of.revenue_cents()).alias("revenue_cents")
    )
    scored = anomaly.rolling_zscores(daily, "revenue_cents", "order_date", groups)
    size = F.abs("zscore")
    return scored.filter(size > 2).select(
        "order_date", *groups, (F.col("revenue_cents") / 100).alias("revenue"), rounded(F.col("mean") / 100, 4).alias("mean"),
        rounded(F.col("zscore")).alias("zscore"), anomaly.severity_of(size).alias("severity"),
    )


def _all_anomalies(star: Star, days: int | None = None) -> DataFrame:
    daily = _daily(star, days)
    return anomaly.all_anomalies(_revenue_anomalies(daily), _order_anomalies(daily))


@query()
def all_anomalies(star: Star) -> DataFrame:
    return _flat(_all_anomalies(star))


@query()
def alerts(star: Star) -> DataFrame:
    alerted_at = dt.datetime.combine(star.as_of(), dt.time())
    return anomaly.alerts(_all_anomalies(star), alerted_at).drop("timestamp")


@query()
def alert_summary(star: Star) -> DataFrame:
    return anomaly.alert_summary(_all_anomalies(star))


@query()
def column_outliers(star: Star) -> DataFrame:
    """Outliers in every numeric column of the order lines."""
    return anomaly.column_outliers(star.table("lineitem"))


@query()
def recent_and_change(star: Star) -> DataFrame:
    """The last ten months and each one's percent change, 0 where the month before had none."""
    changes = dashboard.period_change(_monthly_revenue(star), "order_month", "revenue")
    return (
        changes.withColumn("change_pct", F.coalesce("growth_pct", F.lit(0.0)))
        .select("order_month", "revenue", "change_pct")
        .orderBy(F.col("order_month").desc())
        .limit(10)
    )
