"""Static checks of SQL text as column expressions: an array of issue texts per query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The issue texts.
STAR_SELECT = "Uses SELECT * instead of explicit columns"
CROSS_JOIN = "CROSS JOIN without WHERE clause"
FULL_SCAN = "Potential full table scan without filter"
EXT_STAR_SELECT = "Avoid SELECT * - specify columns explicitly"
EXT_CROSS_JOIN = "CROSS JOIN without WHERE clause may cause cartesian product"
EXT_NON_EQUI = "Non-equi join detected - verify performance"


def has(sql: Column, text: str) -> Column:
    return F.contains(F.upper(sql), F.lit(text))


def unfiltered_cross_join(sql: Column) -> Column:
    return has(sql, "CROSS JOIN") & ~has(sql, "WHERE")


def _issues(found: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(flag, F.lit(text)) for text, flag in found.items()]))


def issues(sql: Column) -> Column:
    restricted = has(sql, "WHERE") | has(sql, "LIMIT") | has(sql, "GROUP BY") | has(sql, "JOIN")
    return _issues({
        STAR_SELECT: has(sql, "SELECT *"),
        CROSS_JOIN: unfiltered_cross_join(sql),
        FULL_SCAN: has(sql, "SELECT") & ~restricted,
    })


def issues_ext(sql: Column) -> Column:
    """Without the scan flag, with one for an inequality in a query that joins on a condition."""
    joins_on = sql.rlike(r"(?i)\bJOIN\b") & sql.rlike(r"(?i)\bON\b")
    return _issues({
        EXT_STAR_SELECT: has(sql, "SELECT *"),
        EXT_CROSS_JOIN: unfiltered_cross_join(sql),
        EXT_NON_EQUI: joins_on & sql.rlike("[<>]"),
    })
