"""A query log derived from the events table, one logged query per event.

The tables at hand hold no SQL, so each event stands for one run of a query: its type
picks the statement, its user the approach and the constants, and failures carry an
error text. Log size and skew follow the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.sources.star import Star

STATEMENT = """CASE event_type
  WHEN 'view' THEN 'SELECT * FROM orders WHERE customer_id = ' || user_id
  WHEN 'click' THEN 'SELECT customer_id, AVG(price) FROM fact_orders GROUP BY customer_id HAVING SUM(price) > ' || user_id
  WHEN 'purchase' THEN 'SELECT o.order_id, p.category FROM orders o INNER JOIN products p ON o.product_id = p.product_id'
    || CASE WHEN user_id % 2 = 0 THEN ' AND o.quantity >= ' || user_id ELSE '' END
  WHEN 'signup' THEN 'SELECT c.customer_id, p.product_id FROM customers c CROSS JOIN products p'
    || CASE WHEN user_id % 2 = 0 THEN ' WHERE c.customer_id = ' || user_id ELSE '' END
  ELSE 'select order_id, region from orders' END"""

PASSED = "event_type <> 'error' AND user_id % 5 <> 0"

ERROR = """CASE event_id % 4
  WHEN 0 THEN 'column region must appear in the GROUP BY clause'
  WHEN 1 THEN 'Ambiguous reference to column customer_id'
  WHEN 2 THEN 'Table sales_' || user_id || ' does not exist'
  ELSE 'Timeout' END"""


def query_log(star: Star) -> DataFrame:
    """``task_id, approach, genome_id, sql, tokens, latency, score, passed, error``."""
    return star.table("events").select(
        F.col("event_id").alias("task_id"),
        F.concat(F.lit("approach_"), F.col("user_id") % 3).alias("approach"),
        F.col("user_id").alias("genome_id"),
        F.expr(STATEMENT).alias("sql"),
        F.floor("value").cast("long").alias("tokens"),
        (F.col("event_id") % 100 / F.lit(100.0)).alias("latency"),
        (F.col("value") / (F.col("value") + 1)).alias("score"),
        F.expr(PASSED).alias("passed"),
        F.expr(f"CASE WHEN NOT ({PASSED}) THEN {ERROR} END").alias("error"),
        "event_id", "user_id", "event_type",
    )
