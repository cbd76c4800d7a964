"""The ten benchmark questions."""

from oracle.common import FACT, MEAN_REVENUE, ORDERS, REVENUE

SQL = {
    "revenue_by_region": f"""WITH {FACT} SELECT region, {REVENUE} AS total_revenue FROM fact GROUP BY 1
      ORDER BY 2 DESC NULLS LAST, 1""",
    "orders_by_segment": f"""WITH {FACT} SELECT customer_segment, {ORDERS} AS order_count FROM fact
      JOIN customer ON c_custkey = customer_id GROUP BY 1""",
    "top10_customers": f"""WITH {FACT} SELECT customer_id, customer_name, {REVENUE} AS revenue FROM fact
      JOIN customer ON c_custkey = customer_id GROUP BY 1, 2 ORDER BY revenue DESC NULLS LAST, customer_id LIMIT 10""",
    "monthly_revenue_year": f"""WITH {FACT} SELECT order_month, {REVENUE} AS revenue FROM fact
      WHERE extract(year FROM order_date) = 2000 GROUP BY 1 ORDER BY 1""",
    "avg_value_by_category": f"""WITH {FACT} SELECT product_category, {MEAN_REVENUE} AS avg_order_value
      FROM fact JOIN part ON p_partkey = product_id GROUP BY 1""",
    "customers_gt5_orders": f"""WITH {FACT} SELECT customer_id, customer_name, COUNT(order_id) AS order_count FROM fact
      GROUP BY 1, 2 HAVING COUNT(order_id) > 5 ORDER BY 3 DESC, 1""",
    "revenue_per_customer_by_state": f"""WITH {FACT} SELECT customer_state, COUNT(DISTINCT customer_id) AS customer_count,
      {REVENUE} AS total_revenue, {REVENUE} / NULLIF(COUNT(DISTINCT customer_id), 0) AS revenue_per_customer
      FROM fact GROUP BY 1""",
    "never_ordered": """SELECT p_partkey AS product_id, p_name AS product_name, p_type AS product_category
      FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE l_orderkey IS NULL""",
    "orders_without_lines": """SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
      o_custkey AS customer_id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL""",
    "revenue_by_year": f"""WITH {FACT} SELECT CAST(extract(year FROM order_date) AS BIGINT) AS year,
      {REVENUE} AS revenue FROM fact GROUP BY 1""",
    "top5_regions_avg_qty": f"""WITH {FACT} SELECT region, CAST(SUM(quantity) AS DOUBLE) / COUNT(quantity) AS avg_quantity
      FROM fact GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 5""",
}
