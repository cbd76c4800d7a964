"""KPIs, measures and their tests."""

from oracle.common import FACT, SALES

REV = "CAST(SUM(quantity * price) AS DOUBLE)"
PROFIT = "CAST(SUM(quantity * price - quantity * product_cost) AS DOUBLE)"

# key -> (formula, grain, tests as (type, violation))
KPIS = {
    "revenue": (REV, "order_date, region, customer_segment, product_category",
                [("not_null", "{k} IS NULL"), ("positive", "{k} <= 0"), ("range", "{k} < 0 OR {k} > 100000000")]),
    "aov": (f"{REV} / NULLIF(COUNT(DISTINCT order_id), 0)", "order_date, region",
            [("not_null", "{k} IS NULL"), ("positive", "{k} <= 0"), ("range", "{k} < 0 OR {k} > 10000")]),
    "order_count": ("COUNT(DISTINCT order_id)", "order_date, region",
                    [("not_null", "{k} IS NULL"), ("non_negative", "{k} < 0")]),
    "customer_count": ("COUNT(DISTINCT customer_id)", "order_date, region",
                       [("not_null", "{k} IS NULL"), ("non_negative", "{k} < 0")]),
    "gross_profit": (PROFIT, "order_date, region, product_category", [("not_null", "{k} IS NULL")]),
    "profit_margin": (f"{PROFIT} / NULLIF({REV}, 0)", "order_date, region",
                      [("range", "{k} < -1 OR {k} > 1")]),
    "revenue_per_customer": (f"{REV} / NULLIF(COUNT(DISTINCT customer_id), 0)", "order_date, region",
                             [("positive", "{k} <= 0")]),
}

SQL = {
    f"kpi_{key}": f"WITH {SALES} SELECT {grain}, {formula} AS {key} FROM sales GROUP BY {grain}"
    for key, (formula, grain, _) in KPIS.items()
}
SQL["kpi_order_rows"] = f"WITH {SALES} SELECT order_date, COUNT(order_id) AS order_rows FROM sales GROUP BY 1"
SQL["kpi_at_grain"] = (
    f"WITH {SALES} SELECT region, {PROFIT} / NULLIF({REV}, 0) AS profit_margin FROM sales GROUP BY 1"
)
SQL["kpi_at_grain_total"] = f"WITH {SALES} SELECT {REV} / NULLIF(COUNT(DISTINCT order_id), 0) AS aov FROM sales"
SQL["kpi_all_grains"] = f"""WITH {SALES} SELECT GROUPING(order_date, region, customer_segment, product_category) AS level,
  order_date, region, customer_segment, product_category, {REV} AS revenue, COUNT(*) AS lines, COUNT(DISTINCT customer_id) AS customers,
  {REV} / NULLIF(COUNT(DISTINCT customer_id), 0) AS revenue_per_customer
  FROM sales GROUP BY CUBE (order_date, region, customer_segment, product_category)"""
SQL["measure_totals"] = f"""WITH {SALES} SELECT {REV} AS total_revenue, COUNT(DISTINCT order_id) AS total_orders,
  coalesce({REV} / NULLIF(COUNT(DISTINCT order_id), 0), 0) AS avg_order_value FROM sales"""
SQL["measure_yoy_growth"] = f"""WITH {FACT}, m AS (
    SELECT order_month, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM fact GROUP BY 1)
  SELECT a.order_month, a.revenue, b.revenue AS prior_revenue,
    coalesce((a.revenue - b.revenue) / NULLIF(b.revenue, 0), 0) AS yoy_growth
  FROM m a LEFT JOIN m b ON a.order_month = b.order_month + INTERVAL '1' YEAR ORDER BY 1"""
SQL["kpi_tests"] = f"WITH {SALES}" + "".join(
    f", k_{key} AS (SELECT {formula} AS {key} FROM sales GROUP BY {grain})"
    for key, (formula, grain, _) in KPIS.items()
) + " UNION ALL ".join(
    f""" SELECT '{key}' AS kpi, '{test}' AS test, COUNT(*) AS result_rows,
      COUNT(*) FILTER (WHERE {broken.format(k=key)}) AS violations,
      CAST(MIN({key}) AS DOUBLE) AS min_value, CAST(MAX({key}) AS DOUBLE) AS max_value,
      COUNT(*) FILTER (WHERE {broken.format(k=key)}) = 0 AS passed FROM k_{key}"""
    for key, (_, _, tests) in KPIS.items() for test, broken in tests
)
