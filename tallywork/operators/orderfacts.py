"""Order facts: the lines of a sales table collapsed to one row per order.

Nearly every report counts distinct orders or customers next to additive totals. Over raw
lines that makes Spark expand each row once per distinct count. Collapsing the lines to
orders first (partial aggregation on the map side, so a hot order shrinks before it moves)
leaves one row per order and grain: counting orders becomes a plain count, and at most
one true distinct (customers) remains, which Spark plans in two skew-proof steps.

Money is held as exact partial sums (``revenue_hi``/``_lo``, ``gross_profit_hi``/``_lo``, see
``functions.numbers``); the aggregates at the end of this module recombine them.

``order_id`` is the primary key of the orders, so an order has one customer and one date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions.numbers import decimal_cents, exact_sum, ratio, rounded, summed_parts
from tallywork.sources.star import NEEDS, Star, fact_column

LINE_KEYS = {"product_id", "product_name", "product_category"}


# The line column that each measure of the star schema's sales is computed from.
LINE_COLUMN = {
    "quantity": "quantity",
    "revenue": "revenue_cents",
    "gross_profit": "gross_profit_cents",
    "profit_margin": "line_margin",
}


def _collapsing(columns: Iterable[str]) -> list[Column]:
    columns = set(columns)
    aggregates = [F.count(F.lit(1)).alias("line_count")]
    if "quantity" in columns:
        aggregates.append(F.sum("quantity").alias("quantity"))
    for name in ("revenue", "gross_profit"):
        if f"{name}_cents" in columns:
            aggregates += summed_parts(f"{name}_cents", name)
        elif name in columns:
            aggregates += summed_parts(decimal_cents(name), name)
    for name in ("revenue_cents", "revenue"):
        if name in columns:
            aggregates.append(F.count(name).alias("revenue_rows"))
            break
    for name in ("line_margin", "profit_margin"):
        if name in columns:
            aggregates.append(F.sum(name).alias("margin_sum"))
            aggregates.append(F.count(name).alias("margin_rows"))
            break
    return aggregates


def collapse(fact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per order within ``keys``, from any fact table with order and customer ids."""
    grouping = list(dict.fromkeys([*keys, "order_id", "customer_id"]))
    return fact.groupBy(*grouping).agg(*_collapsing(fact.columns))


def order_facts(
    star: Star,
    keys: Sequence[str],
    measures: Sequence[str],
    since: dt.date | None = None,
    until: dt.date | None = None,
) -> DataFrame:
    """``collapse`` over the star schema's sales.

    Without a date window the lines are aggregated before they meet the order headers, so
    that one exchange on the order serves both steps. With a window the (small) set of
    headers filters the lines first.
    """
    if since is not None or until is not None:
        columns = dict.fromkeys([*keys, "order_id", "customer_id", *map(LINE_COLUMN.get, measures)])
        return collapse(star.sales(columns, since, until), keys)
    line_keys = [k for k in keys if k in LINE_KEYS]
    values = [LINE_COLUMN[m] for m in measures]
    needs = set(line_keys).union(*(NEEDS.get(v, {v}) for v in values))
    lines = star.order_lines(needs).select("order_id", *line_keys, *map(fact_column, values))
    lines = lines.groupBy("order_id", *line_keys).agg(*_collapsing(values))
    header_keys = [k for k in keys if k not in LINE_KEYS]
    header_columns = set().union({"customer_id"}, *(NEEDS.get(k, {k}) for k in header_keys))
    headers = star.order_headers(header_columns)
    extra = [k for k in header_keys if k not in ("order_id", "customer_id")]
    headers = headers.select("order_id", "customer_id", *map(fact_column, extra))
    return lines.join(headers, "order_id", "inner")


# Aggregates over order facts --------------------------------------------------------

def order_count() -> Column:
    return F.count("order_id")


def customer_count() -> Column:
    return F.count_distinct("customer_id")


def quantity() -> Column:
    return F.sum("quantity").cast("long")


def revenue() -> Column:
    return exact_sum("revenue").cast("double")


def revenue_cents() -> Column:
    """Whole cents."""
    return (exact_sum("revenue") * 100).cast("long")


def profit() -> Column:
    return exact_sum("gross_profit").cast("double")


def revenue_per(count: Column) -> Column:
    return ratio(exact_sum("revenue"), count)


def mean_line_revenue() -> Column:
    return ratio(exact_sum("revenue"), F.sum("revenue_rows"))


def mean_margin() -> Column:
    return rounded(ratio(F.sum("margin_sum"), F.sum("margin_rows")))
