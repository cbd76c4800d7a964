"""Marts."""

from oracle.common import (
    AS_OF, CUSTOMERS, FACT, MARGIN, MEAN_REVENUE, ORDERS, PROFIT, QUANTITY, REVENUE, dbl,
)

SIGNUP = """signup AS (
  SELECT o_custkey AS customer_id, CAST(min(o_orderdate) AS DATE) AS signup_date FROM orders GROUP BY 1)"""

SQL = {
    "fact_orders": f"""WITH {FACT} SELECT order_id, order_date, customer_id, product_id, region, quantity,
      {dbl('price')} AS price, {dbl('revenue')} AS revenue, customer_segment, customer_state, product_category,
      {dbl('product_cost')} AS product_cost, {dbl('gross_profit')} AS gross_profit, profit_margin, order_month,
      CAST(date_trunc('quarter', order_date) AS DATE) AS order_quarter,
      CAST(date_trunc('year', order_date) AS DATE) AS order_year,
      CAST(extract(year FROM order_date) AS BIGINT) AS year,
      CAST(extract(quarter FROM order_date) AS BIGINT) AS quarter,
      CAST(extract(month FROM order_date) AS BIGINT) AS month,
      CAST(extract(dow FROM order_date) AS BIGINT) AS day_of_week
      FROM fact""",
    "dim_customer": f"""WITH {FACT}, {SIGNUP}
      SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, c.c_mktsegment AS segment, n.n_name AS state,
        s.signup_date, COUNT(DISTINCT f.order_id) AS lifetime_orders, {dbl('SUM(f.revenue)')} AS lifetime_revenue,
        {dbl('SUM(f.revenue)')} / NULLIF(COUNT(f.revenue), 0) AS avg_order_value,
        MIN(f.order_date) AS first_order_date, MAX(f.order_date) AS last_order_date,
        date_diff('day', MAX(f.order_date), {AS_OF}) AS days_since_last_order
      FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
      LEFT JOIN signup s ON s.customer_id = c.c_custkey LEFT JOIN fact f ON f.customer_id = c.c_custkey
      GROUP BY 1, 2, 3, 4, 5""",
    "fct_revenue_daily": f"""WITH {FACT} SELECT order_date, region, customer_segment, product_category,
      {ORDERS} AS order_count, {CUSTOMERS} AS customer_count, {QUANTITY} AS total_quantity,
      {REVENUE} AS total_revenue, {PROFIT} AS total_profit, {MEAN_REVENUE} AS avg_order_value,
      {MARGIN} AS avg_profit_margin FROM fact GROUP BY 1, 2, 3, 4""",
    "fct_kpis_monthly": f"""WITH {FACT} SELECT order_month, region, {ORDERS} AS order_count,
      {CUSTOMERS} AS customer_count, {REVENUE} AS revenue, {PROFIT} AS gross_profit,
      {REVENUE} / NULLIF({ORDERS}, 0) AS aov, {REVENUE} / NULLIF({CUSTOMERS}, 0) AS revenue_per_customer,
      {MARGIN} AS avg_profit_margin FROM fact GROUP BY 1, 2 ORDER BY 1 DESC NULLS LAST, 2 NULLS LAST""",
    "fct_product_performance": f"""WITH {FACT} SELECT p.p_partkey AS product_id, p.p_name AS product_name,
      p.p_type AS category, COUNT(DISTINCT f.order_id) AS order_count,
      CAST(SUM(f.quantity) AS BIGINT) AS total_quantity_sold, {dbl('SUM(f.revenue)')} AS total_revenue,
      {dbl('SUM(f.gross_profit)')} AS total_profit, round(AVG(f.profit_margin), 6) AS avg_profit_margin,
      MIN(f.order_date) AS first_sale_date, MAX(f.order_date) AS last_sale_date
      FROM part p LEFT JOIN fact f ON f.product_id = p.p_partkey GROUP BY 1, 2, 3
      ORDER BY total_revenue DESC NULLS LAST, product_id""",
    "fct_customer_cohorts": f"""WITH {FACT}, {SIGNUP}
      SELECT CAST(date_trunc('month', s.signup_date) AS DATE) AS cohort_month, f.order_month,
        date_diff('month', date_trunc('month', s.signup_date), f.order_month) AS months_since_signup,
        COUNT(DISTINCT f.customer_id) AS customer_count, COUNT(DISTINCT f.order_id) AS order_count,
        {dbl('SUM(f.revenue)')} AS revenue
      FROM signup s JOIN fact f ON f.customer_id = s.customer_id WHERE f.order_date IS NOT NULL
      GROUP BY 1, 2, 3 ORDER BY 1, 2""",
}
