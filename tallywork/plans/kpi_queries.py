"""KPI queries over the star schema."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame

from tallywork.operators import orderfacts as of
from tallywork.operators.orderfacts import order_facts
from tallywork.plans import kpis
from tallywork.plans.kpi_specs import KPIS, ORDER_ROWS, KpiSpec
from tallywork.plans.registry import query
from tallywork.sources.star import Star


def _kpi(star: Star, spec: KpiSpec, grain=None) -> DataFrame:
    return kpis.kpis_over_facts(star, [spec], spec.grain if grain is None else grain)


for _spec in KPIS.values():
    query(f"kpi_{_spec.key}")(partial(_kpi, spec=_spec))
query("kpi_order_rows")(partial(_kpi, spec=ORDER_ROWS))
# Coarser grains of the same specifications.
query("kpi_at_grain")(partial(_kpi, spec=KPIS["profit_margin"], grain=["region"]))
query("kpi_at_grain_total")(partial(_kpi, spec=KPIS["aov"], grain=[]))


@query()
def kpi_all_grains(star: Star) -> DataFrame:
    """Revenue and customers at every subset of the revenue grain."""
    return kpis.kpis_at_all_grains(star, KPIS["revenue"].grain)


@query()
def measure_totals(star: Star) -> DataFrame:
    return kpis.measure_totals(order_facts(star, [], ["revenue"]))


@query()
def measure_yoy_growth(star: Star) -> DataFrame:
    monthly = order_facts(star, ["order_month"], ["revenue"]).groupBy("order_month").agg(
        of.revenue().alias("revenue")
    )
    return kpis.yoy_growth(monthly)


@query()
def kpi_tests(star: Star) -> DataFrame:
    """One aggregation per distinct grain, shared by all KPIs defined at it."""
    by_grain: dict[tuple[str, ...], list[KpiSpec]] = {}
    for spec in KPIS.values():
        by_grain.setdefault(spec.grain, []).append(spec)
    report = None
    for grain, specs in by_grain.items():
        tested = kpis.kpi_tests(kpis.kpis_over_facts(star, specs, grain), specs)
        report = tested if report is None else report.unionByName(tested)
    return report
