"""Marts on hand-made retail tables with gaps and odd rows."""

import datetime as dt

import pytest

from tallywork.operators.orderfacts import collapse
from tallywork.plans import kpis, marts
from tallywork.plans.kpi_specs import KPIS
from tallywork.sources.retail import retail_sales
from tests.conftest import rows

D = dt.date


@pytest.fixture(scope="module")
def tables(spark):
    orders = spark.createDataFrame(
        [
            (1, D(2022, 1, 15), 1, 1, 2, 10.0, "East"),
            (2, D(2022, 1, 20), 1, 2, 1, 0.0, "East"),       # no revenue
            (3, D(2022, 2, 1), None, 1, 1, 10.0, "West"),    # no customer
            (4, D(2022, 2, 2), 2, None, 1, 10.0, "West"),    # no product
            (5, D(2022, 2, 3), 99, 1, 3, 10.0, "West"),      # unknown customer
            (6, D(2021, 12, 31), 2, 1, 1, 8.0, "East"),      # before signup
        ],
        "order_id int, order_date date, customer_id int, product_id int, quantity int, price double, region string",
    )
    customers = spark.createDataFrame(
        [
            (1, "A", "Corporate", "TX", D(2022, 1, 1)),
            (2, "B", "Consumer", "NY", D(2022, 2, 1)),
            (3, "C", "Consumer", "NY", D(2022, 3, 1)),       # never orders
        ],
        "customer_id int, customer_name string, segment string, state string, signup_date date",
    )
    products = spark.createDataFrame(
        [(1, "P", "Furniture", 4.0), (2, "Q", "Technology", 1.0), (3, "R", "Technology", 1.0)],
        "product_id int, product_name string, category string, cost double",
    )
    return orders, customers, products


@pytest.fixture(scope="module")
def fact(tables):
    return retail_sales(*tables)


def test_fact_keeps_unmatched_rows(fact):
    out = marts.fact_orders(fact)
    assert out.columns == list(marts.FACT_COLUMNS)
    found = {r.order_id: r for r in out.collect()}
    assert len(found) == 6
    assert found[2].profit_margin is None and found[2].gross_profit == -1.0
    assert found[4].product_cost is None and found[4].gross_profit is None
    assert found[5].customer_segment is None
    assert found[1].profit_margin == pytest.approx(0.6)
    assert found[1].day_of_week == 6  # a Saturday
    assert found[6].order_quarter == D(2021, 10, 1)


def test_dim_customer(tables, fact):
    out = {r.customer_id: r for r in marts.dim_customer(tables[1], collapse(fact, ["order_date"]), D(2022, 3, 1)).collect()}
    assert out[1].lifetime_orders == 2 and out[1].lifetime_revenue == 20.0
    assert out[1].avg_order_value == 10.0 and out[1].days_since_last_order == 40
    assert out[3].lifetime_orders == 0 and out[3].lifetime_revenue is None
    assert out[3].days_since_last_order is None


def test_product_performance_includes_never_sold(tables, fact):
    products = tables[2].withColumnRenamed("category", "product_category").selectExpr(
        "product_id", "product_name", "product_category", "cast(cost as decimal(12,2)) product_cost"
    )
    out = marts.fct_product_performance(products, fact).collect()
    assert [r.product_id for r in out] == [1, 2, 3]
    best, free, unsold = out
    assert (best.order_count, best.total_quantity_sold, best.total_revenue) == (4, 7, 68.0)
    assert best.total_profit == 68.0 - 28.0
    # three sales at 10 and one at 8, cost 4
    assert best.avg_profit_margin == pytest.approx((0.6 * 3 + 0.5) / 4)
    assert free.avg_profit_margin is None and free.total_revenue == 0.0
    assert unsold.order_count == 0 and unsold.total_revenue is None


def test_cohorts_have_negative_months(tables, fact):
    out = rows(marts.fct_customer_cohorts(tables[1], collapse(fact, ["order_month"])))
    assert (D(2022, 2, 1), D(2021, 12, 1), -2, 1, 1, 8.0) in out
    assert (D(2022, 1, 1), D(2022, 1, 1), 0, 1, 2, 20.0) in out
    assert len(out) == 3


def test_daily_rolls_up_to_monthly(spark, star):
    from tallywork.plans import all_queries

    queries = all_queries()
    daily = queries["fct_revenue_daily"](spark, star.path)
    monthly = queries["fct_kpis_monthly"](spark, star.path)
    a = daily.selectExpr("round(sum(total_revenue), 2) r", "round(sum(total_profit), 2) p").first()
    b = monthly.selectExpr("round(sum(revenue), 2) r", "round(sum(gross_profit), 2) p").first()
    assert a == b


def test_kpi_grain_must_be_declared(fact):
    with pytest.raises(ValueError):
        kpis.kpi_at_grain(fact, KPIS["aov"], ["product_category"])


def test_kpi_formulas(fact):
    out = rows(kpis.kpi_at_grain(fact, KPIS["aov"], ["region"]))
    assert out == [("East", pytest.approx(28 / 3)), ("West", pytest.approx(50 / 3))]


def test_yoy_finds_the_month_not_the_row(spark):
    months = spark.createDataFrame(
        [(D(2022, 1, 1), 100.0), (D(2022, 3, 1), 50.0), (D(2023, 1, 1), 150.0), (D(2023, 2, 1), 70.0)],
        "order_month date, revenue double",
    )
    growth = {r.order_month: r.yoy_growth for r in kpis.yoy_growth(months).collect()}
    assert growth == {D(2022, 1, 1): 0.0, D(2022, 3, 1): 0.0, D(2023, 1, 1): 0.5, D(2023, 2, 1): 0.0}


def test_kpi_test_report(spark):
    results = spark.createDataFrame([(5.0, 1), (None, 0), (-1.0, 2)], "aov double, order_count int")
    out = {
        (r.kpi, r.test): (r.violations, r.passed)
        for r in kpis.kpi_tests(results, [KPIS["aov"], KPIS["order_count"]]).collect()
    }
    assert out[("aov", "not_null")] == (1, False)
    assert out[("aov", "positive")] == (1, False)
    assert out[("aov", "range")] == (1, False)
    assert out[("order_count", "not_null")] == (0, True)
    assert out[("order_count", "non_negative")] == (0, True)
