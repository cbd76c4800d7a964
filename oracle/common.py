"""Shared common table expressions of the checking SQL."""

AS_OF = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"

SALES = """sales AS (
  SELECT l.l_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS order_date, o.o_custkey AS customer_id,
    l.l_partkey AS product_id, CAST(l.l_quantity AS INT) AS quantity,
    CAST(l.l_extendedprice AS DECIMAL(12,2)) AS price,
    r.r_name AS region, c.c_name AS customer_name, c.c_mktsegment AS customer_segment,
    n.n_name AS customer_state, p.p_name AS product_name, p.p_type AS product_category,
    CAST(p.p_retailprice AS DECIMAL(12,2)) AS product_cost
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN part p ON p.p_partkey = l.l_partkey)"""

FACT = SALES + """, fact AS (
  SELECT *, quantity * price AS revenue,
    (quantity * price) - (quantity * product_cost) AS gross_profit,
    CAST((quantity * price) - (quantity * product_cost) AS DOUBLE)
      / NULLIF(CAST(quantity * price AS DOUBLE), 0) AS profit_margin,
    CAST(date_trunc('month', order_date) AS DATE) AS order_month
  FROM sales)"""


def dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


REVENUE = "CAST(SUM(revenue) AS DOUBLE)"
PROFIT = "CAST(SUM(gross_profit) AS DOUBLE)"
ORDERS = "COUNT(DISTINCT order_id)"
CUSTOMERS = "COUNT(DISTINCT customer_id)"
QUANTITY = "CAST(SUM(quantity) AS BIGINT)"
MEAN_REVENUE = "CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue)"
MARGIN = "round(AVG(profit_margin), 6)"
