"""The star schema as the retail model: one ``sales`` row per order line.

A view joins only those dimensions that its caller's columns need, because Catalyst keeps
a left join to a dimension even where none of its columns survive. Dimensions carry no
broadcast hint: Spark broadcasts them when their measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise joins by shuffle, where AQE splits
skewed keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.functions import dates
from tallywork.functions.numbers import cents_sql, money_sql, ratio
from tallywork.schema import STAR

PRODUCT_COLUMNS = {"product_name", "product_category", "product_cost", "product_cost_cents"}
CUSTOMER_COLUMNS = {"customer_name", "customer_segment"}
STATE_COLUMNS = {"customer_state"}
REGION_COLUMNS = {"region"}

# Fact columns computed from the joined ones, with the columns each needs.
NEEDS = {
    "revenue": {"quantity", "price"},
    "gross_profit": {"quantity", "price", "product_cost"},
    "profit_margin": {"quantity", "price", "product_cost"},
    "revenue_cents": {"quantity", "price_cents"},
    "gross_profit_cents": {"quantity", "price_cents", "product_cost_cents"},
    "line_margin": {"quantity", "price_cents", "product_cost_cents"},
    "order_month": {"order_date"},
    "order_quarter": {"order_date"},
    "order_year": {"order_date"},
    "year": {"order_date"},
    "quarter": {"order_date"},
    "month": {"order_date"},
    "day_of_week": {"order_date"},
}


def _revenue() -> Column:
    return F.col("quantity") * F.col("price")


def _profit() -> Column:
    return _revenue() - F.col("quantity") * F.col("product_cost")


def _revenue_cents() -> Column:
    return F.col("quantity") * F.col("price_cents")


def _profit_cents() -> Column:
    return _revenue_cents() - F.col("quantity") * F.col("product_cost_cents")


DERIVED: dict[str, Callable[[], Column]] = {
    "revenue": _revenue,
    "gross_profit": _profit,
    "profit_margin": lambda: ratio(_profit(), _revenue()),
    "revenue_cents": _revenue_cents,
    "gross_profit_cents": _profit_cents,
    "line_margin": lambda: ratio(_profit_cents(), _revenue_cents()),
    "order_month": lambda: dates.month_start(F.col("order_date")),
    "order_quarter": lambda: dates.quarter_start(F.col("order_date")),
    "order_year": lambda: dates.year_start(F.col("order_date")),
    "year": lambda: dates.year(F.col("order_date")),
    "quarter": lambda: dates.quarter(F.col("order_date")),
    "month": lambda: dates.month(F.col("order_date")),
    "day_of_week": lambda: dates.day_of_week(F.col("order_date")),
}


def fact_column(name: str) -> Column:
    """A fact column by name, computed where it is a derived one."""
    return DERIVED[name]().alias(name) if name in DERIVED else F.col(name)


class Star:
    """The tables of one Parquet directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read.schema(STAR.schema(name))
            self._tables[name] = reader.parquet(f"{self.path}/{name}.parquet")
        return self._tables[name]

    def as_of(self) -> dt.date:
        """Default reporting day: the latest order date (a one-column scan, one row back)."""
        latest = self.table("orders").agg(F.max("o_orderdate").cast("date"))
        return latest.first()[0]

    # -- dimensions -----------------------------------------------------------------

    def _geography(self, customer: DataFrame, columns: set[str]) -> DataFrame:
        if columns & (STATE_COLUMNS | REGION_COLUMNS):
            nation = self.table("nation").select("n_nationkey", "n_name", "n_regionkey")
            customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        if columns & REGION_COLUMNS:
            region = self.table("region")
            customer = customer.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        return customer

    def customers(self, columns: Iterable[str] = ()) -> DataFrame:
        """``customer_id`` plus the asked-for columns; one row per customer."""
        wanted = {"customer_id", *columns}
        customer = self._geography(self.table("customer"), wanted)
        available = {
            "customer_id": "c_custkey",
            "customer_name": "c_name",
            "customer_segment": "c_mktsegment",
            "customer_state": "n_name",
            "region": "r_name",
        }
        return customer.selectExpr(*[f"{source} AS {c}" for c, source in available.items() if c in wanted])

    def signups(self) -> DataFrame:
        """Signup day per customer. The tables have none, so it is the first order day."""
        return (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("customer_id"))
            .agg(F.min("o_orderdate").cast("date").alias("signup_date"))
        )

    def products(self, columns: Iterable[str] = ("product_name", "product_category", "product_cost")) -> DataFrame:
        wanted = {"product_id", *columns}
        available = {
            "product_id": "p_partkey",
            "product_name": "p_name",
            "product_category": "p_type",
            "product_cost": money_sql("p_retailprice"),
            "product_cost_cents": cents_sql("p_retailprice"),
        }
        return self.table("part").selectExpr(*[f"{e} AS {c}" for c, e in available.items() if c in wanted])

    # -- facts ----------------------------------------------------------------------

    def order_headers(
        self, columns: Iterable[str] = (), since: dt.date | None = None, until: dt.date | None = None
    ) -> DataFrame:
        """One row per order; customer attributes join here, before the lines do.

        The date bounds compare the raw column, so they reach the Parquet scan.
        """
        wanted = {"order_id", *columns}
        orders = self.table("orders")
        if since is not None:
            orders = orders.filter(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
        if until is not None:
            orders = orders.filter(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz"))
        headers = orders.selectExpr(
            "o_orderkey AS order_id", "CAST(o_orderdate AS DATE) AS order_date", "o_custkey AS customer_id"
        )
        attributes = wanted & (CUSTOMER_COLUMNS | STATE_COLUMNS | REGION_COLUMNS)
        if attributes:
            headers = headers.join(self.customers(attributes), "customer_id", "left")
        return headers.select(*[c for c in headers.columns if c in wanted])

    def order_lines(self, columns: Iterable[str] = ()) -> DataFrame:
        """One row per line item, with product attributes where asked for."""
        wanted = {"order_id", *columns}
        lines = self.table("lineitem").selectExpr(
            "l_orderkey AS order_id",
            "l_partkey AS product_id",
            "CAST(l_quantity AS INT) AS quantity",
            f"{money_sql('l_extendedprice')} AS price",
            f"{cents_sql('l_extendedprice')} AS price_cents",
        )
        attributes = wanted & PRODUCT_COLUMNS
        if attributes:
            lines = lines.join(self.products(attributes), "product_id", "left")
        return lines.select(*[c for c in lines.columns if c in wanted])

    def sales(
        self, columns: Iterable[str], since: dt.date | None = None, until: dt.date | None = None
    ) -> DataFrame:
        """Order lines with the asked-for columns, including the derived fact columns.

        Over the whole history the join on the order comes last, so that a following
        aggregation per order needs no exchange of its own. With a date window it comes
        first: the few orders inside cut the lines down before the products join.
        """
        wanted = list(dict.fromkeys(columns))
        raw = set().union(*(NEEDS.get(c, {c}) for c in wanted))
        headers = self.order_headers(raw, since, until)
        if since is None and until is None:
            sales = self.order_lines(raw).join(headers, "order_id", "inner")
        else:
            attributes = raw & PRODUCT_COLUMNS
            keys = {"product_id"} if attributes else set()
            sales = self.order_lines(raw - attributes | keys).join(headers, "order_id", "inner")
            if attributes:
                sales = sales.join(self.products(attributes), "product_id", "left")
        return sales.select(*[fact_column(c) for c in wanted])
