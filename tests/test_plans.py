"""Physical plans: what must be pushed down, and what must not appear."""

import pytest

from tallywork.plans import all_queries
from tests.conftest import DATA

QUERIES = all_queries()
LAZY = (
    "fct_kpis_monthly", "fct_revenue_daily", "fct_product_performance", "fct_customer_cohorts", "dim_customer",
    "kpi_cards", "top_customers", "customers_gt5_orders", "orders_without_lines", "dq_foreign_key",
    "kpi_revenue", "kpi_aov", "kpi_revenue_per_customer", "kpi_tests", "dq_unique", "top10_customers", "orders_by_segment",
    "objective_scores", "generation_stats", "approach_summary", "column_outliers", "lint_report", "table_usage",
)


def plan(spark, name, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", LAZY)
def test_no_products_and_no_forced_broadcast(spark, name):
    """With broadcasting off, every join must still be a shuffled equi-join."""
    text = plan(spark, name, "-1")
    assert "CartesianProduct" not in text and "Broadcast" not in text
    assert "Expand" not in text  # never two distinct counts over one input


def test_date_window_reaches_the_scan(spark):
    text = plan(spark, "trend_daily", "10MB")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate," in text


def test_only_needed_columns_and_dimensions_are_read(spark):
    text = plan(spark, "revenue_by_year", "10MB")
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>" in text
    assert "p_partkey" not in text and "c_custkey" not in text


def test_lines_are_exchanged_once_for_monthly_figures(spark):
    """Without a product column, the exchange on the order serves both aggregation and join."""
    text = plan(spark, "measure_yoy_growth", "-1")
    half = text[: text.index("o_orderkey")]
    assert half.count("Exchange hashpartitioning(order_id") >= 1
    join = text.index("SortMergeJoin [order_id")
    lines = text[join: text.index("FileScan parquet [l_orderkey", join)]
    assert lines.count("Exchange") == 1


def test_elites_are_ranked_without_a_window_per_generation(spark):
    text = plan(spark, "elites", "10MB")
    assert "row_number" not in text  # ranks are running counts within range partitions
