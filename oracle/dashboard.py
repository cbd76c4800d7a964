"""Dashboard, anomaly and insight queries."""

from oracle.common import (
    AS_OF, CUSTOMERS, FACT, MARGIN, MEAN_REVENUE, ORDERS, PROFIT, QUANTITY, REVENUE,
)

RECENT = f"order_date >= {AS_OF} - INTERVAL '90' DAY"
CARDS = " UNION ALL ".join(
    f"""SELECT {days} AS days, {REVENUE} AS total_revenue, {ORDERS} AS total_orders, {CUSTOMERS} AS total_customers,
      {REVENUE} / NULLIF({ORDERS}, 0) AS aov, {PROFIT} AS total_profit, {MARGIN} AS avg_margin
      FROM fact WHERE order_date >= {AS_OF} - INTERVAL '{days}' DAY"""
    for days in (7, 30, 90, 10000)
)
DAILY = f"""daily AS (SELECT order_date, {REVENUE} AS revenue, {ORDERS} AS orders, {PROFIT} AS profit
  FROM fact WHERE {RECENT} GROUP BY 1)"""
MONTHLY = f"monthly AS (SELECT order_month, {REVENUE} AS revenue FROM fact GROUP BY 1)"
CHANGE = f"""{MONTHLY}, change AS (SELECT order_month, revenue, lag(revenue) OVER (ORDER BY order_month) AS previous,
  (revenue - lag(revenue) OVER (ORDER BY order_month))
    / NULLIF(lag(revenue) OVER (ORDER BY order_month), 0) * 100 AS growth_pct FROM monthly)"""
BY_CUSTOMER = "by_customer AS (SELECT customer_id, SUM(revenue) AS revenue FROM fact GROUP BY 1)"


def curve(source: str) -> str:
    return f"""curve AS (SELECT customer_id, CAST(revenue AS DOUBLE) AS revenue,
      CAST(SUM(revenue) OVER (ORDER BY revenue DESC, customer_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_revenue,
      CAST(SUM(revenue) OVER (ORDER BY revenue DESC, customer_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
        / NULLIF(CAST(SUM(revenue) OVER () AS DOUBLE), 0) * 100 AS cumulative_pct FROM {source})"""


PARETO = """SELECT COUNT(*) AS entities, COUNT(*) FILTER (WHERE cumulative_pct <= 80) AS entities_within,
  CAST(COUNT(*) FILTER (WHERE cumulative_pct <= 80) AS DOUBLE) / COUNT(*) * 100 AS pct_within FROM curve"""


def zscores(source: str, metric: str, name: str, alias: str, threshold: float = 2.0) -> str:
    """CTE ``alias``: anomalies of ``metric`` by ``order_date`` in ``source``."""
    return f"""{alias} AS (
      SELECT '{name}' AS metric_name, order_date AS date, v AS value, lo AS expected_lo, hi AS expected_hi,
        CASE WHEN z > 3 THEN 'high' WHEN z > 2.5 THEN 'medium' ELSE 'low' END AS severity,
        printf('{name} of %.2f is %.1fσ from mean', v, z) AS description
      FROM (SELECT order_date, v, abs(v - mu) / NULLIF(sdp, 0) AS z,
          round(mu - {threshold} * sds, 2) AS lo, round(mu + {threshold} * sds, 2) AS hi, n
        FROM (SELECT order_date, CAST({metric} AS DOUBLE) AS v FROM {source}) s,
          (SELECT avg(CAST({metric} AS DOUBLE)) AS mu, stddev_pop(CAST({metric} AS DOUBLE)) AS sdp,
            stddev_samp(CAST({metric} AS DOUBLE)) AS sds, COUNT(*) AS n FROM {source}) t) x
      WHERE n >= 10 AND z > {threshold})"""


ALL_DAILY = f"""all_daily AS (SELECT order_date, {REVENUE} AS daily_revenue, {ORDERS} AS daily_orders
  FROM fact GROUP BY 1)"""
RECENT_DAILY = f"""recent_daily AS (SELECT order_date, {REVENUE} AS daily_revenue, {ORDERS} AS daily_orders,
  {MEAN_REVENUE} AS avg_order_value FROM fact WHERE {RECENT} GROUP BY 1)"""
ALL_FOUND = f"""{ALL_DAILY}, {zscores('all_daily', 'daily_revenue', 'Revenue', 'a1')},
  {zscores('all_daily', 'daily_orders', 'Order Count', 'a2')},
  found AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2)"""
OUTLIER_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
)

SQL = {
    "kpi_cards": f"WITH {FACT} {CARDS}",
    "trend_daily": f"WITH {FACT}, {DAILY} SELECT * FROM daily ORDER BY order_date",
    "trend_daily_summary": f"""WITH {FACT}, daily AS (SELECT order_date, SUM(revenue) AS revenue, {ORDERS} AS orders,
      SUM(gross_profit) AS profit FROM fact WHERE {RECENT} GROUP BY 1)
      SELECT CAST(SUM(revenue) AS DOUBLE) / NULLIF(COUNT(revenue), 0) AS avg_daily_revenue,
        CAST(SUM(orders) AS BIGINT) AS total_orders, CAST(SUM(profit) AS DOUBLE) AS total_profit FROM daily""",
    "trend_monthly": f"""WITH {FACT} SELECT order_month, {REVENUE} AS revenue, {ORDERS} AS orders,
      {CUSTOMERS} AS customers, {PROFIT} AS profit, {MARGIN} AS avg_margin FROM fact GROUP BY 1 ORDER BY 1""",
    "mom_growth": f"""WITH {FACT}, {CHANGE} SELECT * FROM change WHERE previous IS NOT NULL
      ORDER BY order_month DESC LIMIT 1""",
    "mom_growth_series": f"WITH {FACT}, {CHANGE} SELECT * FROM change",
    "top_products": f"""WITH {FACT} SELECT product_name, {REVENUE} AS total_revenue, {QUANTITY} AS total_quantity,
      {PROFIT} AS total_profit, {MARGIN} AS avg_margin, {CUSTOMERS} AS unique_customers
      FROM fact GROUP BY 1 ORDER BY total_revenue DESC NULLS LAST, product_name LIMIT 15""",
    "top_customers": f"""WITH {FACT} SELECT customer_name, {REVENUE} AS total_revenue, {ORDERS} AS total_orders,
      {REVENUE} / NULLIF({ORDERS}, 0) AS avg_order_value, {PROFIT} AS total_profit
      FROM fact GROUP BY 1 ORDER BY total_revenue DESC NULLS LAST, customer_name LIMIT 20""",
    "pareto_80_20": f"""WITH {FACT}, {BY_CUSTOMER},
      best AS (SELECT * FROM by_customer ORDER BY revenue DESC, customer_id LIMIT 20), {curve('best')} {PARETO}""",
    "pareto_80_20_all": f"WITH {FACT}, {BY_CUSTOMER}, {curve('by_customer')} {PARETO}",
    "pareto_curve": f"WITH {FACT}, {BY_CUSTOMER}, {curve('by_customer')} SELECT * FROM curve",
    "daily_metrics_with_z": f"""WITH {FACT}, {RECENT_DAILY},
      t AS (SELECT avg(daily_revenue) AS mu, stddev_pop(daily_revenue) AS sd, COUNT(*) AS n FROM recent_daily),
      z AS (SELECT d.*, CASE WHEN n > 10 THEN (daily_revenue - mu) / NULLIF(sd, 0) END AS z FROM recent_daily d, t)
      SELECT order_date, daily_revenue, daily_orders, avg_order_value, round(z, 6) AS revenue_zscore,
        abs(z) > 2 AS is_anomaly FROM z""",
    "zscore_anomalies": f"""WITH totals AS (SELECT CAST(o_orderdate AS DATE) AS order_date,
      CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS daily_total FROM orders GROUP BY 1),
      {zscores('totals', 'daily_total', 'Order Total', 'a')} SELECT * FROM a""",
    "revenue_anomalies": f"""WITH {FACT}, {RECENT_DAILY},
      {zscores('recent_daily', 'daily_revenue', 'Revenue', 'a')} SELECT * FROM a""",
    "order_anomalies": f"""WITH {FACT}, {RECENT_DAILY},
      {zscores('recent_daily', 'daily_orders', 'Order Count', 'a')} SELECT * FROM a""",
    "rolling_anomalies": f"""WITH {FACT}, daily AS (
        SELECT order_date, region, customer_segment, product_category, CAST(SUM(revenue) * 100 AS BIGINT) AS cents FROM fact GROUP BY 1, 2, 3, 4),
      s AS (SELECT *, COUNT(*) OVER w AS n, SUM(CAST(cents AS HUGEINT)) OVER w AS total, SUM(CAST(cents AS HUGEINT) * cents) OVER w AS squares
        FROM daily WINDOW w AS (PARTITION BY region, customer_segment, product_category ORDER BY order_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
      z AS (SELECT *, CAST(total AS DOUBLE) / n AS mean, CASE WHEN n >= 10 THEN (cents - CAST(total AS DOUBLE) / n)
        / NULLIF(sqrt(CAST(n * squares - total * total AS DOUBLE) / (n * (n - 1))), 0) END AS zscore FROM s)
      SELECT order_date, region, customer_segment, product_category, cents / CAST(100 AS DOUBLE) AS revenue, round(mean / 100, 4) AS mean,
        round(zscore, 6) AS zscore, CASE WHEN abs(zscore) > 3 THEN 'high' WHEN abs(zscore) > 2.5 THEN 'medium' ELSE 'low' END AS severity
      FROM z WHERE abs(zscore) > 2""",
    "all_anomalies": f"WITH {FACT}, {ALL_FOUND} SELECT * FROM found",
    "alerts": f"""WITH {FACT}, {ALL_FOUND} SELECT metric_name AS metric, date, value, severity, description,
      CASE severity WHEN 'high' THEN 'Immediate investigation required for ' || metric_name
        WHEN 'medium' THEN 'Review ' || metric_name || ' trend over next few days'
        ELSE 'Monitor ' || metric_name || ' for continued anomalies' END AS action FROM found""",
    "alert_summary": f"""WITH {FACT}, {ALL_FOUND} SELECT COUNT(*) AS total,
      COUNT(*) FILTER (WHERE severity = 'high') AS high, COUNT(*) FILTER (WHERE severity = 'medium') AS medium,
      COUNT(*) FILTER (WHERE severity = 'low') AS low FROM found""",
    "column_outliers": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE abs({c} - mu) > 2.0 * sd) AS outliers,
          round(any_value(mu), 6) AS mean, round(any_value(sd), 6) AS sd
          FROM lineitem, (SELECT avg({c}) AS mu, stddev_samp({c}) AS sd FROM lineitem) s HAVING any_value(sd) > 0"""
        for c in OUTLIER_COLUMNS
    ),
    "recent_and_change": f"""WITH {FACT}, {CHANGE} SELECT order_month, revenue, coalesce(growth_pct, 0) AS change_pct
      FROM change ORDER BY order_month DESC LIMIT 10""",
}
