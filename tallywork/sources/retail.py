"""The retail model delivered as three tables: orders, customers, products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions.numbers import as_money
from tallywork.sources.star import DERIVED, NEEDS


def retail_sales(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Orders with customer and product attributes and the derived fact columns.

    Left joins: orders of unknown customers or products stay. No broadcast hints; Spark
    broadcasts a dimension when its measured size allows.
    """
    buyers = customers.select(
        "customer_id",
        F.col("segment").alias("customer_segment"),
        F.col("state").alias("customer_state"),
        "customer_name",
    )
    goods = products.select(
        "product_id",
        F.col("category").alias("product_category"),
        "product_name",
        as_money(F.col("cost")).alias("product_cost"),
    )
    joined = (
        orders.withColumn("price", as_money(F.col("price")))
        .join(buyers, "customer_id", "left")
        .join(goods, "product_id", "left")
    )
    return joined.withColumns({c: DERIVED[c]() for c in DERIVED if NEEDS[c] <= set(joined.columns)})
