"""Result comparison, scoring and suite queries over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions.numbers import rounded
from tallywork.operators import compare, matching
from tallywork.operators import orderfacts as of
from tallywork.operators.orderfacts import order_facts
from tallywork.plans import benchmark, evaluation, kpis
from tallywork.plans.kpi_specs import KPIS
from tallywork.plans.registry import query
from tallywork.sources.querylog import query_log
from tallywork.sources.star import Star

SUITE = (
    "revenue_by_region", "orders_by_segment", "top10_customers", "monthly_revenue_year",
    "avg_value_by_category", "customers_gt5_orders", "revenue_per_customer_by_state",
    "never_ordered", "revenue_by_year", "top5_regions_avg_qty",
)
# The KPI tasks and the properties expected of each.
KPI_TASKS = (
    ("kpi_001", "revenue", ("not_null", "positive")),
    ("kpi_002", "aov", ("positive",)),
    ("kpi_003", "customer_count", ("not_null", "positive")),
    ("kpi_004", "gross_profit", ("not_null",)),
    ("kpi_005", "profit_margin", ("range",)),
)


def _nudged(df: DataFrame, column: str, by: str) -> DataFrame:
    """A copy with a third of ``column`` off by less than the tolerance and a third by more."""
    off = F.when(F.expr(by) == 0, 0.0005).when(F.expr(by) == 1, 0.01).otherwise(0.0)
    return df.withColumn(column, F.col(column) + off)


@query()
def compare_results(star: Star) -> DataFrame:
    monthly = order_facts(star, ["order_month", "region"], ["revenue"]).groupBy("order_month", "region").agg(
        of.order_count().alias("order_count"), of.revenue().alias("revenue")
    )
    return compare.compare_results(_nudged(monthly, "revenue", "month(order_month) % 3"), monthly)


@query()
def cell_match_score(star: Star) -> DataFrame:
    lines = star.table("lineitem")
    return compare.cell_match_score(_nudged(lines, "l_tax", "l_partkey % 3"), lines)


@query()
def row_match_score(star: Star) -> DataFrame:
    """The lines against a copy with noise below the tolerance in the first column sorted by, and some prices off."""
    lines = star.table("lineitem")
    noisy = lines.withColumns({
        "l_discount": F.col("l_discount") + F.col("l_partkey") % 3 * F.lit(0.0004),
        "l_extendedprice": F.col("l_extendedprice") + F.when(F.col("l_orderkey") % 7 == 0, 1.0).otherwise(0.0),
    })
    return matching.row_match_score(noisy, lines).withColumn("score", rounded(F.col("score")))


@query()
def evaluate_query(star: Star) -> DataFrame:
    """Answers of every kind: right, wrong, wider, not planned, failing while running, with odd or repeated names."""
    star.sales(["order_id", "region", "quantity", "price"]).createOrReplaceTempView("tallywork_sales")
    gold = "SELECT region, SUM(quantity * price) AS total_revenue FROM tallywork_sales GROUP BY region"
    unnamed = "SELECT region, SUM(quantity * 1.5) FROM tallywork_sales GROUP BY region"
    twice = "SELECT region, region FROM tallywork_sales GROUP BY region"
    answers = {
        "right": (gold + " ORDER BY region", gold),
        "filtered": (gold.replace(" GROUP", " WHERE region <> 'ASIA' GROUP"), gold),
        "wider": ("SELECT * FROM tallywork_sales", gold),
        "failing": (gold.replace("price", "prize"), gold),
        "dividing": (gold.replace("price", "price / (quantity - quantity)"), gold),
        "unnamed": (unnamed, unnamed),
        "twice": (twice, twice),
        "no_gold": (gold, None),
    }
    rows = [evaluation.evaluate_query(star.spark, task, *pair) for task, pair in answers.items()]
    return reduce(DataFrame.unionByName, rows).drop("static_issues", "execution_message", "latency")


@query()
def kpi_properties(star: Star) -> DataFrame:
    spec = KPIS["gross_profit"]
    result = kpis.kpis_over_facts(star, [spec], spec.grain).select("gross_profit")
    properties = ["positive", "not_null", "range", "other"]
    loose = evaluation.kpi_properties(result, properties)
    strict = evaluation.kpi_properties(result, ["range"], bounds=(0.0, 1e6))
    return loose.unionByName(strict.withColumn("property", F.lit("range_with_bounds")))


@query()
def evaluate_kpi(star: Star) -> DataFrame:
    def measure(key: str) -> DataFrame:
        return kpis.kpis_over_facts(star, [KPIS[key]], [])

    rows = [
        evaluation.evaluate_kpi(star.spark, task, lambda key=key: measure(key), properties, KPIS[key].formula_sql)
        for task, key, properties in KPI_TASKS
    ]
    return reduce(DataFrame.unionByName, rows).drop("latency")


def _suite(star: Star) -> DataFrame:
    def dividing() -> DataFrame:
        return star.table("orders").select(F.expr("1 / (o_custkey - o_custkey)"))

    tasks = {name: lambda name=name: getattr(benchmark, name)(star) for name in SUITE}
    return evaluation.suite_report(star.spark, {**tasks, "dividing": dividing, "no_gold": None})


@query()
def suite_report(star: Star) -> DataFrame:
    return _suite(star)


@query()
def suite_summary(star: Star) -> DataFrame:
    return evaluation.suite_summary(_suite(star))


@query()
def approach_summary(star: Star) -> DataFrame:
    return evaluation.approach_summary(query_log(star), baseline="approach_0")


@query()
def genome_metrics(star: Star) -> DataFrame:
    return evaluation.genome_metrics(query_log(star))
