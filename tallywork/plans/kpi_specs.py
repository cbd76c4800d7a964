"""KPI specifications: formula, finest grain and the tests its result must pass.

``formula_sql`` is the definition over raw sales lines; ``facts`` computes the same over order facts with the
named ``measures``, where an order is one row (per product grain, if there is any).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywork.functions.numbers import exact_sum, ratio
from tallywork.operators import orderfacts as of


@dataclass(frozen=True)
class KpiTest:
    type: str  # not_null, positive, non_negative or range
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class KpiSpec:
    key: str
    name: str
    formula_nl: str
    formula_sql: str
    grain: tuple[str, ...]
    inputs: tuple[str, ...]
    aggregation: str
    format: str
    result: str = "double"
    tests: tuple[KpiTest, ...] = field(default=())
    measures: tuple[str, ...] = ()
    facts: Callable[[], Column] | None = None
    counts_orders: bool = False


NOT_NULL = KpiTest("not_null")
POSITIVE = KpiTest("positive")
NON_NEGATIVE = KpiTest("non_negative")

DAY_REGION = ("order_date", "region")
REVENUE = "CAST(SUM(quantity * price) AS DOUBLE)"
PROFIT = "CAST(SUM(quantity * price - quantity * product_cost) AS DOUBLE)"

# Names, grains, test types and bounds of the seven KPIs.
KPIS = {
    spec.key: spec
    for spec in (
        KpiSpec(
            "revenue", "Revenue", "Sum of quantity times price for all orders", REVENUE,
            ("order_date", "region", "customer_segment", "product_category"),
            ("quantity", "price"), "SUM", "currency",
            tests=(NOT_NULL, POSITIVE, KpiTest("range", 0, 100000000)),
            measures=("revenue",), facts=of.revenue,
        ),
        KpiSpec(
            "aov", "Average Order Value", "Total revenue divided by count of distinct orders",
            f"{REVENUE} / NULLIF(COUNT(DISTINCT order_id), 0)", DAY_REGION,
            ("quantity", "price", "order_id"), "DERIVED", "currency",
            tests=(NOT_NULL, POSITIVE, KpiTest("range", 0, 10000)),
            measures=("revenue",), facts=lambda: of.revenue_per(of.order_count()), counts_orders=True,
        ),
        KpiSpec(
            "order_count", "Order Count", "Count of distinct order IDs", "COUNT(DISTINCT order_id)",
            DAY_REGION, ("order_id",), "COUNT_DISTINCT", "number", "long",
            tests=(NOT_NULL, NON_NEGATIVE), facts=of.order_count, counts_orders=True,
        ),
        KpiSpec(
            "customer_count", "Customer Count", "Count of distinct customer IDs with orders",
            "COUNT(DISTINCT customer_id)", DAY_REGION, ("customer_id",), "COUNT_DISTINCT", "number", "long",
            tests=(NOT_NULL, NON_NEGATIVE), facts=of.customer_count,
        ),
        KpiSpec(
            "gross_profit", "Gross Profit", "Sum of (revenue minus cost) for all orders", PROFIT,
            ("order_date", "region", "product_category"),
            ("quantity", "price", "product_cost"), "SUM", "currency",
            tests=(NOT_NULL,), measures=("gross_profit",), facts=of.profit,
        ),
        KpiSpec(
            "profit_margin", "Profit Margin", "Gross profit divided by revenue",
            f"{PROFIT} / NULLIF({REVENUE}, 0)", DAY_REGION,
            ("quantity", "price", "product_cost"), "DERIVED", "percentage",
            tests=(KpiTest("range", -1, 1),), measures=("revenue", "gross_profit"),
            facts=lambda: ratio(exact_sum("gross_profit"), exact_sum("revenue")),
        ),
        KpiSpec(
            "revenue_per_customer", "Revenue Per Customer", "Total revenue divided by count of unique customers",
            f"{REVENUE} / NULLIF(COUNT(DISTINCT customer_id), 0)", DAY_REGION,
            ("quantity", "price", "customer_id"), "DERIVED", "currency",
            tests=(POSITIVE,), measures=("revenue",), facts=lambda: of.revenue_per(of.customer_count()),
        ),
    )
}

# The project-level order count counts rows, unlike the distinct count above.
ORDER_ROWS = KpiSpec(
    "order_rows", "OrderCount", "total number of orders", "COUNT(order_id)",
    ("order_date",), ("order_id",), "COUNT", "number", "long", facts=lambda: F.sum("line_count"),
)


def read_specs(path: str, columns: Iterable[str]) -> dict[str, KpiSpec]:
    """Specifications from a YAML file: ``kpis`` by key, each with formula_sql, grain and tests as above.

    ``columns`` are those of the sales; an input is a column that the formula names. Such specifications are evaluated
    over raw lines (``kpis_at_grain``). Integer results are declared with ``result: long``.
    """
    import yaml  # only needed here

    with open(path, encoding="utf-8") as file:
        config = yaml.safe_load(file)
    known, specs = set(columns), {}
    for key, body in config["kpis"].items():
        grain = body.get("grain", [])
        specs[key] = KpiSpec(
            key, body.get("name", key), body.get("formula_nl", ""), body["formula_sql"],
            tuple([grain] if isinstance(grain, str) else grain),
            tuple(sorted(known & set(re.findall(r"[A-Za-z_]\w*", body["formula_sql"])))),
            body.get("aggregation", ""), body.get("format", ""), body.get("result", "double"),
            tests=tuple(KpiTest(t["type"], t.get("min"), t.get("max")) for t in body.get("tests", [])),
        )
    return specs
