"""Result comparison, scoring and suites."""

from oracle.benchmark import SQL as QUESTIONS
from oracle.common import FACT, ORDERS, REVENUE, SALES
from oracle.kpis import KPIS
from tallywork.plans.kpi_specs import KPIS as SPECS
from oracle.querylog import CROSS, LOG, SCAN, STAR_SELECT


def aligned(got: str, want: str, columns: list[str], fractional: set[str]) -> str:
    """Matching cells of two equally long tables, sorted by ``columns``."""
    order = ", ".join(f"{c} NULLS LAST" for c in columns)
    same = " + ".join(
        f"CAST(coalesce(abs(g.{c} - w.{c}) <= CAST(0.001 AS DOUBLE), g.{c} IS NULL AND w.{c} IS NULL) AS BIGINT)"
        if c in fractional else f"CAST(g.{c} IS NOT DISTINCT FROM w.{c} AS BIGINT)"
        for c in columns
    )
    return f"""SELECT CAST(SUM({same}) AS DOUBLE) / (COUNT(*) * {len(columns)}) AS score
      FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM {got}) g
      JOIN (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM {want}) w USING (rn)"""


LINE_COLUMNS = sorted(
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
    "l_linestatus l_shipdate".split()
)
OFF = "CASE {by} WHEN 0 THEN CAST(0.0005 AS DOUBLE) WHEN 1 THEN CAST(0.01 AS DOUBLE) ELSE 0 END"
SUITE = (
    "revenue_by_region orders_by_segment top10_customers monthly_revenue_year avg_value_by_category "
    "customers_gt5_orders revenue_per_customer_by_state never_ordered revenue_by_year top5_regions_avg_qty"
).split()
PROFITS = f"p AS (SELECT {KPIS['gross_profit'][0]} AS v FROM sales GROUP BY {KPIS['gross_profit'][1]})"
TOTALS = "t AS (SELECT " + ", ".join(f"{formula} AS {key}" for key, (formula, _, _) in KPIS.items()) + " FROM sales)"


def kpi_task(task: str, key: str, conditions: list[str]) -> str:
    held = " + ".join(f"CAST({c} AS BIGINT)" for c in conditions)
    n = len(conditions)
    return f"""SELECT '{task}' AS task_id, ({held}) = {n} AS passed,
      CAST(0.6 AS DOUBLE) + CAST({held} AS DOUBLE) / {n} * CAST(0.4 AS DOUBLE) AS score, TRUE AS execution_match,
      ({held}) = {n} AS static_checks_passed, CAST({2 * len(SPECS[key].formula_sql.split())} AS BIGINT) AS token_cost FROM t"""


SUMMED = """summed AS (SELECT approach, COUNT(*) AS tasks,
    CAST(COUNT(*) FILTER (WHERE error IS NULL AND score > CAST(0.7 AS DOUBLE)) AS DOUBLE) / COUNT(*) * 100 AS accuracy_pct,
    coalesce(CAST(SUM(tokens) FILTER (WHERE error IS NULL) AS DOUBLE), 0)
      / greatest(COUNT(*) FILTER (WHERE error IS NULL), 1) AS avg_tokens,
    coalesce(CAST(SUM(CAST(latency AS DECIMAL(18,6))) FILTER (WHERE error IS NULL) AS DOUBLE), 0)
      / greatest(COUNT(*) FILTER (WHERE error IS NULL), 1) AS avg_latency,
    COUNT(error) AS errors,
    round(coalesce(CAST(SUM(tokens) FILTER (WHERE error IS NULL) AS DOUBLE), 0) * CAST(0.000001 AS DOUBLE), 9) AS total_cost
  FROM log GROUP BY 1)"""

GOLD = "SELECT region, SUM(quantity * price) AS total_revenue FROM tallywork_sales GROUP BY region"


def query_score(task: str, sql: str, execution: str, static: bool) -> str:
    share = 1.0 if static else 0.5
    matched = f"({execution}) >= CAST(0.95 AS DOUBLE)"
    return f"""SELECT '{task}' AS task_id, {matched} AND {static} AS passed,
      ({execution}) * CAST(0.7 AS DOUBLE) + CAST({share} AS DOUBLE) * CAST(0.3 AS DOUBLE) AS score,
      {matched} AS execution_match, {static} AS static_checks_passed,
      CAST({2 * len(sql.split())} AS BIGINT) AS token_cost, {execution} AS execution_score FROM n"""


# Every question counts its rows; a division by zero fails if there is any row to divide; one task has no question.
REPORT = " UNION ALL ".join([
    *[f"SELECT '{k}' AS task_id, TRUE AS passed, COUNT(*) AS rows, CAST(NULL AS VARCHAR) AS error FROM ({QUESTIONS[k]})" for k in SUITE],
    """SELECT 'dividing', COUNT(*) = 0, CASE WHEN COUNT(*) = 0 THEN 0 END,
      CASE WHEN COUNT(*) > 0 THEN 'DIVIDE_BY_ZERO' END FROM orders""",
    "SELECT 'no_gold', FALSE, NULL, 'No gold SQL provided'",
])


SQL = {
    # What each answer must score, given how many regions it returns.
    "evaluate_query": f"""WITH {SALES}, n AS (SELECT COUNT(DISTINCT region) AS all_regions,
        COUNT(DISTINCT region) FILTER (WHERE region <> 'ASIA') AS kept FROM sales) """ + " UNION ALL ".join([
        query_score("right", GOLD + " ORDER BY region", "CAST(1 AS DOUBLE)", True),
        query_score("filtered", GOLD.replace(" GROUP", " WHERE region <> 'ASIA' GROUP"),
                    "CAST(CASE WHEN kept = all_regions THEN 1 WHEN kept = 0 THEN 0 ELSE 0.6 END AS DOUBLE)", True),
        query_score("wider", "SELECT * FROM tallywork_sales", "CAST(0.5 AS DOUBLE)", False),
        query_score("failing", GOLD, "CAST(0 AS DOUBLE)", True),
        query_score("dividing", GOLD.replace("price", "price / (quantity - quantity)"), "CAST(0 AS DOUBLE)", True),
        query_score("unnamed", "SELECT region, SUM(quantity * 1.5) FROM tallywork_sales GROUP BY region", "CAST(1 AS DOUBLE)", True),
        query_score("twice", "SELECT region, region FROM tallywork_sales GROUP BY region", "CAST(1 AS DOUBLE)", True),
        query_score("no_gold", GOLD, "CAST(0 AS DOUBLE)", True)]),
    "compare_results": f"""WITH {FACT}, m AS (SELECT order_month, region, {ORDERS} AS order_count, {REVENUE} AS revenue
        FROM fact GROUP BY 1, 2),
      n AS (SELECT * REPLACE (revenue + {OFF.format(by='month(order_month) % 3')} AS revenue) FROM m),
      s AS ({aligned('n', 'm', ['order_count', 'order_month', 'region', 'revenue'], {'revenue'})})
      SELECT score >= CAST(0.95 AS DOUBLE) AS passed, score, printf('Match score: %.3f', score) AS message FROM s""",
    "cell_match_score": f"""WITH n AS (SELECT * REPLACE (l_tax + {OFF.format(by='l_partkey % 3')} AS l_tax) FROM lineitem)
      {aligned('n', 'lineitem', LINE_COLUMNS, {'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'})}""",
    "row_match_score": """SELECT COUNT(*) AS got_rows, COUNT(*) AS want_rows, COUNT(*) FILTER (WHERE l_orderkey % 7 <> 0) AS matched,
      round(COUNT(*) FILTER (WHERE l_orderkey % 7 <> 0) / CAST(COUNT(*) AS DOUBLE), 6) AS score FROM lineitem""",
    "kpi_properties": f"""WITH {SALES}, {PROFITS}
      SELECT 'positive' AS property, COUNT(*) > 0 AND bool_and(coalesce(v >= 0, FALSE)) AS passed FROM p
      UNION ALL SELECT 'not_null', COUNT(*) > 0 AND bool_and(v IS NOT NULL) FROM p
      UNION ALL SELECT 'range', COUNT(*) > 0 FROM p UNION ALL SELECT 'other', COUNT(*) > 0 FROM p
      UNION ALL SELECT 'range_with_bounds', COUNT(*) > 0 AND bool_and(coalesce(v BETWEEN 0 AND 1000000, FALSE)) FROM p""",
    "evaluate_kpi": f"WITH {SALES}, {TOTALS} " + " UNION ALL ".join([
        kpi_task("kpi_001", "revenue", ["revenue IS NOT NULL", "coalesce(revenue >= 0, FALSE)"]),
        kpi_task("kpi_002", "aov", ["coalesce(aov >= 0, FALSE)"]),
        kpi_task("kpi_003", "customer_count", ["customer_count IS NOT NULL", "coalesce(customer_count >= 0, FALSE)"]),
        kpi_task("kpi_004", "gross_profit", ["gross_profit IS NOT NULL"]),
        kpi_task("kpi_005", "profit_margin", ["TRUE"])]),
    "suite_report": REPORT,
    "suite_summary": f"""SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE passed) AS passed,
      COUNT(*) FILTER (WHERE NOT passed) AS failed,
      CAST(COUNT(*) FILTER (WHERE passed) AS DOUBLE) / COUNT(*) * 100 AS pass_rate_pct FROM ({REPORT})""",
    "approach_summary": f"""WITH {LOG}, {SUMMED}, b AS (SELECT * FROM summed WHERE approach = 'approach_0')
      SELECT s.*, round(s.accuracy_pct - b.accuracy_pct, 6) AS accuracy_delta,
        round((s.avg_tokens / NULLIF(b.avg_tokens, 0) - 1) * 100, 6) AS tokens_delta_pct FROM summed s, b""",
    "genome_metrics": f"""WITH {LOG} SELECT genome_id, round(avg(score), 6) AS accuracy,
      round(CAST(COUNT(*) FILTER (WHERE NOT ({STAR_SELECT} OR {CROSS} OR {SCAN})) AS DOUBLE) / COUNT(*), 6) AS tests,
      CAST(SUM(tokens) AS DOUBLE) / COUNT(*) AS cost, CAST(SUM(CAST(latency AS DECIMAL(18,6))) AS DOUBLE) / COUNT(latency) AS latency,
      COUNT(*) AS tasks_evaluated, CAST(SUM(tokens) AS BIGINT) AS total_tokens FROM log GROUP BY 1""",
}
