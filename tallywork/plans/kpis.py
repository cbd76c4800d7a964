"""KPI layer: evaluate specifications at a grain, compose measures, test results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions.numbers import ratio
from tallywork.operators import orderfacts as of
from tallywork.operators.lattice import cube
from tallywork.plans.kpi_specs import KpiSpec, KpiTest
from tallywork.sources.star import Star


def kpis_at_grain(sales: DataFrame, specs: Sequence[KpiSpec], grain: Sequence[str]) -> DataFrame:
    """Several KPIs in one aggregation; ``grain`` may be any subset of every spec's grain."""
    for spec in specs:
        if not set(grain) <= set(spec.grain):
            raise ValueError(f"{spec.key} is defined at {spec.grain}, not at {tuple(grain)}")
    return sales.groupBy(*grain).agg(
        *[F.expr(spec.formula_sql).cast(spec.result).alias(spec.key) for spec in specs]
    )


def kpi_at_grain(sales: DataFrame, spec: KpiSpec, grain: Sequence[str] | None = None) -> DataFrame:
    return kpis_at_grain(sales, [spec], spec.grain if grain is None else grain)


def kpis_over_facts(star: Star, specs: Sequence[KpiSpec], grain: Sequence[str]) -> DataFrame:
    """Several KPIs in one aggregation of the star's order facts.

    Lines collapse to orders first, so counting orders is a plain count, and money adds up as integers.
    """
    for spec in specs:
        if not set(grain) <= set(spec.grain) or spec.counts_orders and set(grain) & of.LINE_KEYS:
            raise ValueError(f"{spec.key} is defined at {spec.grain}, not at {tuple(grain)}")
    measures = list(dict.fromkeys(m for spec in specs for m in spec.measures))
    return of.order_facts(star, grain, measures).groupBy(*grain).agg(
        *[spec.facts().cast(spec.result).alias(spec.key) for spec in specs]
    )


def kpis_at_all_grains(star: Star, grain: Sequence[str]) -> DataFrame:
    """Revenue, lines, distinct customers and revenue per customer for every subset of ``grain``, lines read once.

    ``level`` tells the subset, as GROUPING does.
    """
    facts = of.order_facts(star, grain, ["revenue"])
    sums = ["revenue_hi", "revenue_lo", "line_count"]
    found = cube(facts, grain, sums, "customer_id", [of.revenue().alias("revenue"), F.sum("line_count").alias("lines")])
    return found.withColumnRenamed("members", "customers").withColumn(
        "revenue_per_customer", ratio(F.col("revenue"), F.col("customers"))
    )


def measure_totals(orders: DataFrame) -> DataFrame:
    """Total Revenue, Total Orders and their quotient, 0 where there is no order."""
    count = of.order_count()
    return orders.agg(
        of.revenue().alias("total_revenue"),
        count.alias("total_orders"),
        F.coalesce(of.revenue_per(count), F.lit(0.0)).alias("avg_order_value"),
    )


def yoy_growth(monthly: DataFrame) -> DataFrame:
    """Growth over the same month of the year before; 0 where that is missing or zero.

    ``monthly`` has ``order_month`` and ``revenue``. The prior year is found by its month,
    not by a row offset, so gaps in the series do not shift it.
    """
    prior = monthly.select(
        F.add_months("order_month", 12).alias("order_month"), F.col("revenue").alias("prior_revenue")
    )
    growth = ratio(F.col("revenue") - F.col("prior_revenue"), F.col("prior_revenue"))
    return (
        monthly.join(prior, "order_month", "left")
        .select("order_month", "revenue", "prior_revenue", F.coalesce(growth, F.lit(0.0)).alias("yoy_growth"))
        .orderBy("order_month")
    )


def _violations(value: Column, test: KpiTest) -> Column:
    """Number of result rows that break ``test``; NULL breaks only ``not_null``."""
    broken = {
        "not_null": value.isNull(),
        "positive": value <= 0,
        "non_negative": value < 0,
        "range": (value < F.lit(test.min)) | (value > F.lit(test.max)),
    }[test.type]
    return F.count_if(F.coalesce(broken, F.lit(False)))


def kpi_tests(results: DataFrame, specs: Iterable[KpiSpec]) -> DataFrame:
    """Run every spec's tests over one result table; all in a single aggregation."""
    checks = [(spec, test) for spec in specs for test in spec.tests]
    counted = results.agg(
        F.count(F.lit(1)).alias("result_rows"),
        *[_violations(F.col(s.key), t).alias(f"v{i}") for i, (s, t) in enumerate(checks)],
        *[F.min(s.key).cast("double").alias(f"lo{i}") for i, (s, _) in enumerate(checks)],
        *[F.max(s.key).cast("double").alias(f"hi{i}") for i, (s, _) in enumerate(checks)],
    )
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(s.key).alias("kpi"), F.lit(t.type).alias("test"),
            F.col(f"v{i}").alias("violations"),
            F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"),
        )
        for i, (s, t) in enumerate(checks)
    ]))
    return counted.select("result_rows", rows.alias("check")).select(
        "check.kpi", "check.test", "result_rows", "check.violations", "check.min_value", "check.max_value",
        (F.col("check.violations") == 0).alias("passed"),
    )
