"""Loading source files and building the marts into a warehouse folder."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallywork.operators.orderfacts import collapse
from tallywork.plans import marts
from tallywork.sources import io

REPORT = "name string, rows long, error string"


def _condition(error: Exception) -> str:
    named = getattr(error, "getCondition", None)
    return (named() if named else None) or str(error).splitlines()[0]


def _counted(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n") for name, df in tables.items()
    ]
    return {r.t: r.n for r in reduce(DataFrame.unionByName, counts).collect()} if counts else {}


def _landed(tables: dict[str, DataFrame], folder: str, errors: dict[str, str]) -> dict[str, int]:
    """Each table parsed once, written as Parquet below ``folder`` and counted on the way; ``tables`` then read that."""
    counts = {}
    for name, df in list(tables.items()):
        seen, path = Observation(), os.path.join(folder, name)
        try:
            io.sink_parquet(df.observe(seen, F.count(F.lit(1)).alias("rows")), path)
            counts[name] = seen.get["rows"]
            tables[name] = df.sparkSession.read.schema(df.schema).parquet(path)
        except Exception as error:
            errors[name] = _condition(error)
            del tables[name]
    return counts


def extract_all(
    spark: SparkSession, datasets: Mapping[str, Callable[[], DataFrame]], land: str | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Load every dataset; what is missing or unreadable is reported and the rest goes on.

    Returns the loaded tables (also registered by name) and a report ``name, rows, error``.
    All counts come from one job; only if that fails are the tables counted one by one to
    find the unreadable ones. With a folder ``land`` each dataset is parsed once, every value of it, and
    stored there as Parquet, which the returned tables read: for text formats.
    """
    tables, errors = {}, {}
    for name, load in datasets.items():
        try:
            tables[name] = load()
        except FileNotFoundError:
            errors[name] = "not found"
        except Exception as error:  # the report is the place for any failure of one dataset
            errors[name] = _condition(error)
    try:
        counts = _landed(tables, land, errors) if land else _counted(tables)
    except Exception:
        counts = {}
        for name in list(tables):
            try:
                counts |= _counted({name: tables[name]})
            except Exception as error:
                errors[name] = _condition(error)
                del tables[name]
    for name, df in tables.items():
        io.as_table(df, name)
    report = [(name, counts.get(name), errors.get(name)) for name in datasets]
    return tables, spark.createDataFrame(report, REPORT)


def build_marts(
    fact: DataFrame, customers: DataFrame, products: DataFrame, as_of: dt.date, out_dir: str
) -> DataFrame:
    """Write all marts below ``out_dir``; report ``name, rows, error``.

    The fact table is written first, by year, and the other marts read it back: its joins
    run once, and every mart scans only the columns it needs. Row counts are observed while
    writing. ``customers``: customer_id, customer_name, segment, state, signup_date;
    ``products``: product_id, product_name, product_category, product_cost.
    """
    spark = fact.sparkSession
    report = []

    def deliver(name: str, build: Callable[[], DataFrame], partition_by=(), even=True) -> None:
        seen = Observation()
        try:
            counted = build().observe(seen, F.count(F.lit(1)).alias("rows"))
            io.sink_parquet(counted, os.path.join(out_dir, name), partition_by, even)
            report.append((name, seen.get["rows"], None))
        except Exception as error:  # one failed mart must not keep the others from being built
            report.append((name, None, _condition(error)))

    # The widest rows of all stay where the joins put them: years are few.
    deliver("fact_orders", lambda: fact.select(*marts.FACT_COLUMNS), ["year"], even=False)

    def stored() -> DataFrame:
        return spark.read.parquet(os.path.join(out_dir, "fact_orders"))

    signups = customers.select("customer_id", "signup_date")
    deliver("dim_customer", lambda: marts.dim_customer(customers, collapse(stored(), ["order_date"]), as_of))
    deliver("fct_revenue_daily", lambda: marts.fct_revenue_daily(collapse(stored(), marts.DAILY_KEYS)))
    deliver("fct_kpis_monthly", lambda: marts.fct_kpis_monthly(collapse(stored(), marts.MONTHLY_KEYS)))
    # A line is smaller than the sums of a product in an order, so the lines move.
    sold = ["product_id", "order_id", "order_date", "quantity", "price"]
    deliver("fct_product_performance", lambda: marts.fct_product_performance(products, stored().select(*sold).repartition("order_id")))
    deliver(
        "fct_customer_cohorts", lambda: marts.fct_customer_cohorts(signups, collapse(stored(), ["order_month"]))
    )
    return spark.createDataFrame(report, REPORT)
