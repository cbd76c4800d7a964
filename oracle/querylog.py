"""The derived query log as a common table expression."""


STATEMENT = """CASE event_type
  WHEN 'view' THEN 'SELECT * FROM orders WHERE customer_id = ' || user_id
  WHEN 'click' THEN 'SELECT customer_id, AVG(price) FROM fact_orders GROUP BY customer_id HAVING SUM(price) > ' || user_id
  WHEN 'purchase' THEN 'SELECT o.order_id, p.category FROM orders o INNER JOIN products p ON o.product_id = p.product_id'
    || CASE WHEN user_id % 2 = 0 THEN ' AND o.quantity >= ' || user_id ELSE '' END
  WHEN 'signup' THEN 'SELECT c.customer_id, p.product_id FROM customers c CROSS JOIN products p'
    || CASE WHEN user_id % 2 = 0 THEN ' WHERE c.customer_id = ' || user_id ELSE '' END
  ELSE 'select order_id, region from orders' END"""
PASSED = "event_type <> 'error' AND user_id % 5 <> 0"
ERROR = f"""CASE WHEN NOT ({PASSED}) THEN CASE event_id % 4
  WHEN 0 THEN 'column region must appear in the GROUP BY clause'
  WHEN 1 THEN 'Ambiguous reference to column customer_id'
  WHEN 2 THEN 'Table sales_' || user_id || ' does not exist'
  ELSE 'Timeout' END END"""
LOG = f"""log AS (SELECT event_id AS task_id, 'approach_' || (user_id % 3) AS approach, user_id AS genome_id,
  {STATEMENT} AS sql, CAST(floor(value) AS BIGINT) AS tokens, CAST(event_id % 100 AS DOUBLE) / 100 AS latency,
  value / (value + 1) AS score, {PASSED} AS passed, {ERROR} AS error, event_id, user_id, event_type FROM events)"""

UP = "upper(sql)"
STAR_SELECT = f"contains({UP}, 'SELECT *')"
CROSS = f"(contains({UP}, 'CROSS JOIN') AND NOT contains({UP}, 'WHERE'))"
SCAN = f"""(contains({UP}, 'SELECT') AND NOT contains({UP}, 'WHERE') AND NOT contains({UP}, 'LIMIT')
  AND NOT contains({UP}, 'GROUP BY') AND NOT contains({UP}, 'JOIN'))"""
NON_EQUI = r"(regexp_matches(sql, '(?i)\bJOIN\b') AND regexp_matches(sql, '(?i)\bON\b') AND regexp_matches(sql, '[<>]'))"
