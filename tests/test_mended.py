"""Cases in which rows, groups or digits once got lost."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywork.operators import compare, configured, textjobs
from tallywork.plans import all_queries, dashboard, evaluation
from tests.conftest import rows

QUERIES = all_queries()


def test_all_time_reaches_back_without_bound(spark):
    orders = spark.createDataFrame(
        [(1, 7, dt.date(1890, 1, 1)), (2, 7, dt.date(2022, 1, 1)), (3, 8, dt.date(2021, 12, 1)), (4, None, dt.date(2022, 1, 1))],
        "order_id long, customer_id long, order_date date",
    ).select(
        "*", *[F.lit(x).cast("long").alias(c) for c, x in (("revenue_hi", 0), ("revenue_lo", 100), ("gross_profit_hi", 0), ("gross_profit_lo", 50), ("margin_rows", 1))],
        F.lit(0.5).alias("margin_sum"),
    )
    cards = dashboard.kpi_cards(orders, dt.date(2022, 1, 1))
    assert rows(cards, "days", "total_orders", "total_customers", "total_revenue") == sorted(
        [(7, 2, 1, 2.0), (30, 2, 1, 2.0), (90, 3, 2, 3.0), (10000, 4, 2, 4.0)], key=repr
    )


def test_null_groups_stay(spark):
    log = spark.createDataFrame([(None, "SELECT * FROM t", 1.0), (None, "SELECT a FROM t", 3.0), ("x", "SELECT a FROM t", 2.0)], "approach string, sql string, latency double")
    assert {r.approach for r in textjobs.lint_report(log).collect()} == {None, "x"}
    assert rows(configured.latency_distribution(log, "approach", "latency", (50, 99))) == sorted(
        [(None, 50, 1.0), (None, 99, 3.0), ("x", 50, 2.0), ("x", 99, 2.0)], key=repr
    )


def test_unknown_customers_and_products(spark, star, tmp_path):
    """Orphans are left out by the inner joins and do not use up the ten best."""
    for name in ("region", "nation", "customer", "part", "orders", "lineitem"):
        df = star.table(name)
        if name == "orders":
            df = df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_orderkey")).otherwise(F.col("o_custkey")))
        if name == "lineitem":
            df = df.withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1).cast(df.schema["l_partkey"].dataType)).otherwise(F.col("l_partkey")))
            df = df.withColumn("l_extendedprice", F.col("l_extendedprice") * F.when(F.col("l_orderkey") % 2 == 0, 50).otherwise(1))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    path = str(tmp_path)
    assert QUERIES["top10_customers"](spark, path).filter("customer_name is not null").count() == 10
    assert QUERIES["orders_by_segment"](spark, path).filter("customer_segment is null").count() == 0
    assert QUERIES["avg_value_by_category"](spark, path).filter("product_category is null").count() == 0


def test_comparison_of_odd_columns(spark):
    odd = spark.sql("SELECT id * 1.5, id AS `a.b`, map('k', id) AS m, id AS x, id + 1 AS x FROM range(5)")
    assert tuple(compare.compare_results(odd, odd).first())[:2] == (True, 1.0)
    other = spark.sql("SELECT id * 1.5, id AS `a.b`, map('k', id) AS m, id AS x, id + 2 AS x FROM range(5)")
    assert compare.cell_match_score(odd, other).first()[0] == pytest.approx(0.8)
    assert compare.compare_results(odd, odd.drop("m")).first().score == 0.5


def test_running_errors_score_nothing(spark):
    bad = "SELECT 1 / (id - 2) AS v FROM range(5)"
    row = evaluation.evaluate_query(spark, "t", bad, bad).first()
    assert (row.execution_score, row.passed) == (0.0, False) and "DIVIDE_BY_ZERO" in row.execution_message
    report = evaluation.suite_report(spark, {"a": lambda: spark.range(3), "b": lambda: spark.sql(bad), "c": None})
    assert rows(report, "task_id", "passed", "rows") == [("a", True, 3), ("b", False, None), ("c", False, None)]
    kpi = evaluation.evaluate_kpi(spark, "k", lambda: spark.sql(bad), ("positive",)).first()
    assert (kpi.score, kpi.execution_match) == (0.0, False)


def test_copies_are_found_by_the_whole_digest(spark):
    texts = spark.createDataFrame([("n", "a"), ("n", "a"), ("n", "b")], "name string, text string")
    assert textjobs.duplicate_components(texts, "name", "text").count() == 1


def test_kpis_from_a_file(spark, star, tmp_path):
    from tallywork.plans import kpis
    from tallywork.plans.kpi_specs import KPIS, read_specs

    (tmp_path / "kpis.yaml").write_text(
        "kpis:\n  aov:\n    name: AOV\n    formula_sql: CAST(SUM(quantity * price) AS DOUBLE) / COUNT(DISTINCT order_id)\n"
        "    grain: [order_date, region]\n    tests:\n      - {type: not_null}\n      - {type: range, min: 0, max: 10}\n"
    )
    spec = read_specs(str(tmp_path / "kpis.yaml"), ["order_id", "quantity", "price", "region"])["aov"]
    assert spec.inputs == ("order_id", "price", "quantity") and spec.grain == ("order_date", "region")
    got = kpis.kpi_at_grain(star.sales(["region", *spec.inputs]), spec, ["region"])
    assert rows(got) == rows(kpis.kpis_over_facts(star, [KPIS["aov"]], ["region"]))
    assert [r.passed for r in kpis.kpi_tests(got, [spec]).orderBy("test").collect()] == [True, False]


def test_wide_tables_keep_their_column_order(spark):
    """More than ten columns: both sides are sorted by the columns as their names sort."""
    wide = spark.range(40).select(*[((F.col("id") * (n + 3)) % 7).alias(f"k{n:02d}") for n in range(13)])
    other = wide.withColumn("k02", F.when(F.col("k03") == 0, -1).otherwise(F.col("k02")))
    a, b = (sorted(map(tuple, df.collect())) for df in (wide, other))
    same = sum(x == y for r, s in zip(a, b) for x, y in zip(r, s))
    assert compare.cell_match_score(wide, other).first()[0] == pytest.approx(same / (40 * 13))
