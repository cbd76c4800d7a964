"""Data-quality queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.operators import quality as q
from tallywork.plans.registry import query
from tallywork.schema import STAR
from tallywork.sources.star import Star


def _flat(report: DataFrame, *details: str) -> DataFrame:
    return report.select("name", "passed", "message", *[F.col("details")[d].alias(d) for d in details])


@query()
def dq_not_null(star: Star) -> DataFrame:
    checks = [q.NotNull("l_orderkey"), q.NotNull("l_shipdate"), q.NotNull("l_quantity", 0.95)]
    report = q.run_checks("lineitem", star.table("lineitem"), checks)
    return _flat(report, "null_count", "total", "non_null_pct")


@query()
def dq_unique(star: Star) -> DataFrame:
    """A key that is unique and a foreign key that is not."""
    good = q.run_checks("orders", star.table("orders"), [q.Unique("o_orderkey")])
    bad = q.run_checks("lineitem", star.table("lineitem"), [q.Unique("l_orderkey")])
    return _flat(good.unionByName(bad), "total", "unique", "duplicates")


@query()
def dq_range(star: Star) -> DataFrame:
    checks = [q.InRange("l_discount", 0, 0.05), q.InRange("l_tax", 0, 1), q.InRange("l_quantity", min=1)]
    report = q.run_checks("lineitem", star.table("lineitem"), checks)
    return _flat(report, "in_range", "total", "actual_min", "actual_max")


@query()
def dq_foreign_key(star: Star) -> DataFrame:
    lines, orders = star.table("lineitem"), star.table("orders")
    shipped = lines.select(F.col("l_orderkey").alias("filled_orderkey"))
    reports = [
        q.check_foreign_key("lineitem", lines, q.ForeignKey("l_orderkey", "orders", "o_orderkey"), orders),
        q.check_foreign_key("lineitem", lines, q.ForeignKey("l_partkey", "part", "p_partkey"), star.table("part")),
        # Orders need not have lines, so the reverse direction finds orphans.
        q.check_foreign_key("orders", orders, q.ForeignKey("o_orderkey", "lineitem", "filled_orderkey"), shipped),
    ]
    return _flat(reports[0].unionByName(reports[1]).unionByName(reports[2]), "orphaned_count")


def _suite(star: Star) -> DataFrame:
    return q.suite_from_schema(STAR, star.table)


@query()
def dq_suite_from_schema(star: Star) -> DataFrame:
    return _suite(star).select("name", "passed", "message")


@query()
def dq_summary(star: Star) -> DataFrame:
    return q.summary(_suite(star))


@query()
def coverage_check(star: Star) -> DataFrame:
    """Every column of the labelled documents at least 90 % filled, and a row budget."""
    labelled = star.table("documents").join(star.table("labels"), "doc_id", "left")
    checks = [q.NotNull(c, 0.9) for c in labelled.columns]
    report = q.run_checks("labelled", labelled, checks)
    return report.unionByName(q.row_limit("labelled", labelled, 1000000)).select("name", "passed", "message")
