"""Ratios, exact money totals and rounding.

Money is summed exactly, so that results do not depend on the order of addition. Sums of
wide DECIMALs are slow on Spark (one big-number object per row), so the facts add whole
cents as BIGINTs, split into a high and a low part: each part's sum stays far from
overflow even over trillions of rows, and the two recombine to one DECIMAL at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Money has two decimals; a value with more of them (beyond DOUBLE noise) is an error, never cut.
MONEY = "decimal(12,2)"
NOISE = 1e-4  # of a cent
FINER = "a money value has more than two decimals"


def as_money(value: Column) -> Column:
    """Two-decimal fixed point, so that sums do not depend on the order of addition; raises on finer values."""
    cents = value.cast("double") * 100
    return F.when(F.abs(cents - F.round(cents)) > NOISE, F.raise_error(F.lit(FINER)).cast(MONEY)).otherwise(value.cast(MONEY))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient in DOUBLE; NULL where the denominator is zero."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


PART_BITS = 20


def money_sql(column: str) -> str:
    """SQL for a two-decimal DOUBLE column as fixed point."""
    return f"CAST({column} AS {MONEY})"


def cents_sql(column: str) -> str:
    """SQL for a two-decimal DOUBLE column as whole cents."""
    return (
        f"CASE WHEN ABS({column} * 100 - FLOOR({column} * 100 + 0.5D)) > {NOISE}D "
        f"THEN CAST(RAISE_ERROR('{FINER}') AS BIGINT) ELSE CAST(FLOOR({column} * 100 + 0.5D) AS BIGINT) END"
    )


def decimal_cents(column: str) -> str:
    """SQL for a two-decimal DECIMAL column as whole cents."""
    return f"CAST({column} * 100 AS BIGINT)"


def summed_parts(cents: str, name: str) -> list[Column]:
    """Aggregates ``name_hi`` and ``name_lo`` that together hold the exact sum of the SQL ``cents``."""
    return [
        F.expr(f"SUM(SHIFTRIGHT({cents}, {PART_BITS})) AS {name}_hi"),
        F.expr(f"SUM({cents} & {(1 << PART_BITS) - 1}L) AS {name}_lo"),
    ]


def exact_sum(name: str) -> Column:
    """Sum over rows holding ``name_hi`` and ``name_lo``, as a two-decimal DECIMAL."""
    high, low = (f"CAST(SUM({name}_{part}) AS DECIMAL(20,0))" for part in ("hi", "lo"))
    return F.expr(f"({high} * {1 << PART_BITS} + {low}) * 0.01BD")


def total(value: Column) -> Column:
    """Exact sum (fixed point inside), delivered as DOUBLE."""
    return F.sum(value).cast("double")


def rounded(value: Column, digits: int = 6) -> Column:
    """Averages of DOUBLE ratios: the last bits depend on the order of addition."""
    return F.round(value, digits)
