"""Data-quality expectations; every check yields a row ``name, passed, message, details``.

All column checks of one table run in a single aggregation, but for uniqueness, which takes a distinct each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.functions.numbers import ratio
from tallywork.schema import SchemaRegistry


@dataclass(frozen=True)
class NotNull:
    """The share of non-null values reaches ``threshold``; an empty table has share 0."""

    column: str
    threshold: float = 1.0


@dataclass(frozen=True)
class Unique:
    """As many distinct non-null values as rows, so NULLs count as duplicates.

    With ``more`` columns the values of all together must be distinct, as for a composite key.
    """

    column: str
    more: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column, *self.more)


@dataclass(frozen=True)
class InRange:
    """All non-null values within the inclusive bounds; a missing bound does not bind."""

    column: str
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class ForeignKey:
    """Every non-null value occurs in the referenced column."""

    column: str
    ref_table: str
    ref_column: str


Check = NotNull | Unique | InRange


def _result(name: str, passed: Column, message: Column, details: dict[str, Column]) -> Column:
    pairs = [part for key, value in details.items() for part in (F.lit(key), value.cast("double"))]
    return F.struct(
        F.lit(name).alias("name"), passed.alias("passed"), message.alias("message"),
        F.create_map(*pairs).alias("details"),
    )


def _plan(table: str, check: Check, i: int) -> tuple[list[Column], Column]:
    """Aggregates a check needs, and its result row over them."""
    value, total = F.col(check.column), F.col("total_rows")
    if isinstance(check, NotNull):
        present = F.col(f"c{i}")
        share = F.coalesce(ratio(present, total), F.lit(0.0))
        message = F.format_string(
            f"{check.column}: %.1f%% non-null (threshold: {check.threshold * 100:.1f}%%)", share * 100
        )
        details = {"null_count": total - present, "total": total, "non_null_pct": share}
        row = _result(f"not_null_{table}.{check.column}", share >= check.threshold, message, details)
        return [F.count(value).alias(f"c{i}")], row
    if isinstance(check, Unique):
        unique, name = F.col(f"c{i}"), ", ".join(check.columns)
        message = F.format_string(f"{name}: %d unique of %d total", unique, total)
        details = {"total": total, "unique": unique, "duplicates": total - unique}
        row = _result(f"unique_{table}.{name}", unique == total, message, details)
        return [], row
    bounds = []
    if check.min is not None:
        bounds.append(value >= check.min)
    if check.max is not None:
        bounds.append(value <= check.max)
    within = reduce(Column.__and__, bounds, value.isNotNull())
    present, inside = F.col(f"n{i}"), F.col(f"c{i}")
    message = F.format_string(
        f"{check.column}: %d/%d in range [{check.min}, {check.max}]", inside, present
    )
    details = {
        "in_range": inside, "total": present,
        "actual_min": F.col(f"lo{i}"), "actual_max": F.col(f"hi{i}"),
    }
    row = _result(f"range_{table}.{check.column}", inside == present, message, details)
    return [
        F.count(value).alias(f"n{i}"), F.count_if(within).alias(f"c{i}"),
        F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"),
    ], row


def run_checks(table: str, df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    plans = [_plan(table, check, i) for i, check in enumerate(checks)]
    aggregates = [a for needed, _ in plans for a in needed]
    counted = df.agg(F.count(F.lit(1)).alias("total_rows"), *aggregates)
    # One plain distinct per unique check: several in one aggregation would repeat every row.
    for i, check in enumerate(checks):
        if isinstance(check, Unique):
            distinct = df.select(*check.columns).dropna().distinct().agg(F.count(F.lit(1)))
            counted = counted.withColumn(f"c{i}", distinct.scalar())
    rows = F.explode(F.array(*[row for _, row in plans]))
    return counted.select(rows.alias("r")).select("r.*")


def check_foreign_key(table: str, df: DataFrame, key: ForeignKey, referenced: DataFrame) -> DataFrame:
    """Counts per key come first: a hot key is one row by the time it is shuffled to the join."""
    keys = df.filter(F.col(key.column).isNotNull()).groupBy(F.col(key.column).alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = referenced.select(F.col(key.ref_column).alias("k"))
    counted = keys.join(known, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
    orphans = F.col("orphans")
    message = F.format_string(
        f"{key.column} → {key.ref_table}.{key.ref_column}: %d orphaned rows", orphans
    )
    row = _result(f"fk_{table}.{key.column}", orphans == 0, message, {"orphaned_count": orphans})
    return counted.select(row.alias("r")).select("r.*")


def check_table_exists(spark: SparkSession, table: str) -> DataFrame:
    found = spark.catalog.tableExists(table)
    message = f"Table '{table}' exists" if found else f"Table '{table}' not found"
    return spark.createDataFrame(
        [(f"table_exists_{table}", found, message, {})],
        "name string, passed boolean, message string, details map<string,double>",
    )


def suite_from_schema(
    registry: SchemaRegistry, table: Callable[[str], DataFrame], tables: Sequence[str] | None = None
) -> DataFrame:
    """Primary keys must be complete and unique, foreign keys must resolve."""
    reports = []
    for name in tables or registry.tables:
        keys = registry.primary_keys(name)
        checks = [NotNull(k) for k in keys]
        if keys:
            checks.insert(1, Unique(keys[0], tuple(keys[1:])))
        if checks:
            reports.append(run_checks(name, table(name), checks))
        for column, target in registry.foreign_keys(name).items():
            ref_table, ref_column = target.split(".")
            key = ForeignKey(column, ref_table, ref_column)
            reports.append(check_foreign_key(name, table(name), key, table(ref_table)))
    return reduce(DataFrame.unionByName, reports)


def summary(report: DataFrame) -> DataFrame:
    total, passed = F.count(F.lit(1)), F.count_if(F.col("passed"))
    return report.agg(
        total.alias("total_tests"),
        passed.alias("passed"),
        (total - passed).alias("failed"),
        F.coalesce(ratio(passed, total), F.lit(0.0)).alias("pass_rate"),
    )


def row_limit(table: str, df: DataFrame, max_rows: int) -> DataFrame:
    """Guard against scans above a row budget."""
    rows = F.col("rows")
    message = F.format_string(f"%d rows (limit: {max_rows})", rows)
    row = _result(f"row_limit_{table}", rows <= max_rows, message, {"rows": rows})
    return df.agg(F.count(F.lit(1)).alias("rows")).select(row.alias("r")).select("r.*")
