"""Z-score anomalies of a series, alerts on them, and per-column outlier counts."""

from __future__ import annotations

from collections.abc import Sequence
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.functions.numbers import rounded
from tallywork.operators.globalorder import over_rows_before

# Z-score bounds of the severities, strictest first, and the suggested actions.
SEVERITIES = ((3.0, "high"), (2.5, "medium"))
LOWEST = "low"
ACTIONS = {
    "high": "Immediate investigation required for %s",
    "medium": "Review %s trend over next few days",
    "low": "Monitor %s for continued anomalies",
}


def _by_severity(values: dict[str, Column]) -> Column:
    level = F.col("severity")
    return (
        F.when(level == "high", values["high"])
        .when(level == "medium", values["medium"])
        .otherwise(values["low"])
    )


def with_zscore(series: DataFrame, metric: str, min_rows: int = 10) -> DataFrame:
    """``series`` plus ``mean``, ``spread`` (sample deviation) and ``zscore``.

    The score divides by the population deviation. The statistics come from one
    aggregation, read back as a one-row subquery: no window over the whole series and no
    join. A constant series and one with fewer than ``min_rows`` rows score NULL.
    """
    value = F.col(metric).cast("double")
    stats = series.agg(
        F.struct(
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("sd_pop"),
            F.stddev_samp(value).alias("sd_samp"),
            F.count(F.lit(1)).alias("n"),
        )
    ).scalar()
    scored = series.withColumn("__stats", stats)
    deviation = F.when(F.col("__stats.n") >= min_rows, F.nullif(F.col("__stats.sd_pop"), F.lit(0.0)))
    return scored.select(
        *series.columns,
        F.col("__stats.mean").alias("mean"),
        F.col("__stats.sd_samp").alias("spread"),
        ((value - F.col("__stats.mean")) / deviation).alias("zscore"),
    )


def zscore_anomalies(
    series: DataFrame, metric: str, date: str, name: str, threshold: float = 2.0, min_rows: int = 10
) -> DataFrame:
    """Rows strictly more than ``threshold`` deviations off, with range, severity and text."""
    scored = with_zscore(series, metric, min_rows)
    size = F.abs("zscore")
    reach = F.lit(threshold) * F.col("spread")
    value = F.col(metric).cast("double")
    return scored.filter(size > threshold).select(
        F.lit(name).alias("metric_name"),
        F.col(date).alias("date"),
        value.alias("value"),
        F.struct(
            rounded(F.col("mean") - reach, 2).alias("lo"), rounded(F.col("mean") + reach, 2).alias("hi")
        ).alias("expected_range"),
        severity_of(size).alias("severity"),
        F.format_string("%s of %.2f is %.1fσ from mean", F.lit(name), value, size).alias("description"),
    )


def rolling_zscores(
    series: DataFrame, metric: str, order: str, groups: Sequence[str], rows: int = 30, min_rows: int = 10
) -> DataFrame:
    """``series`` plus ``mean``, ``spread`` (sample deviation) and ``zscore`` against the ``rows`` rows before in its group.

    ``metric`` is a whole number (money in cents), so that sums and squares add up exactly and a rerun gives the same bits.
    Rows come in the order of ``order``, which is unique in a group. With fewer than ``min_rows`` rows before, or all of them
    alike, the score is NULL. A null metric is not counted; the row itself then scores NULL.
    """
    value = F.col(metric).cast("decimal(19,0)")
    found = over_rows_before(series, [F.col(order)], rows, {
        "__n": lambda frame: F.count(metric).over(frame),
        "__sum": lambda frame: F.sum(F.col(metric).cast("long")).over(frame),
        "__squares": lambda frame: F.sum(value * value).over(frame),
    }, groups)
    n, total = F.col("__n"), F.col("__sum").cast("decimal(19,0)")
    above = (n.cast("decimal(10,0)") * F.col("__squares").cast("decimal(28,0)") - total * total).cast("double")
    mean = F.col("__sum") / n
    spread = F.when(n > 1, F.sqrt(above / (n * (n - 1))))
    enough = F.when(n >= min_rows, F.nullif(spread, F.lit(0.0)))
    return found.select(
        *series.columns, F.when(n > 0, mean).alias("mean"), spread.alias("spread"),
        ((F.col(metric) - F.when(n > 0, mean)) / enough).alias("zscore"),
    )


def severity_of(size: Column) -> Column:
    """The level of a z-score's absolute value."""
    severity = F.when(size > SEVERITIES[0][0], SEVERITIES[0][1])
    for bound, level in SEVERITIES[1:]:
        severity = severity.when(size > bound, level)
    return severity.otherwise(LOWEST)


def all_anomalies(*found: DataFrame) -> DataFrame:
    """Union of anomaly tables, most severe first, then by date."""
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    rank = _by_severity({"high": F.lit(0), "medium": F.lit(1), "low": F.lit(2)})
    return merged.orderBy(rank, "date", "metric_name")


def alerts(anomalies: DataFrame, alerted_at: dt.datetime) -> DataFrame:
    """One alert per anomaly; the time is a parameter, so that a rerun gives the same rows."""
    action = _by_severity({k: F.format_string(text, F.col("metric_name")) for k, text in ACTIONS.items()})
    return anomalies.select(
        F.lit(alerted_at).alias("timestamp"),
        F.col("metric_name").alias("metric"),
        "date", "value", "severity", "description",
        action.alias("action"),
    )


def alert_summary(anomalies: DataFrame) -> DataFrame:
    levels = [F.count_if(F.col("severity") == level).alias(level) for level in ("high", "medium", "low")]
    return anomalies.agg(F.count(F.lit(1)).alias("total"), *levels)


def column_outliers(df: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Per numeric column: rows more than ``threshold`` sample deviations off the mean.

    Two aggregations over all columns at once. Date columns and constant ones are left out.
    """
    numeric = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and not f.name.endswith("_date")
    ]
    parts = []
    for column in numeric:
        value = F.col(column).cast("double")
        parts += [F.avg(value).alias(f"{column}_mean"), F.stddev_samp(value).alias(f"{column}_sd")]
    stats = df.agg(F.struct(*parts)).scalar()
    with_stats = df.select(*numeric, stats.alias("__stats"))
    counts = with_stats.agg(
        F.first("__stats").alias("__stats"),
        *[
            F.count_if(
                F.abs(F.col(c).cast("double") - F.col(f"__stats.{c}_mean"))
                > threshold * F.col(f"__stats.{c}_sd")
            ).alias(c)
            for c in numeric
        ],
    )
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col(c).alias("outliers"),
            F.col(f"__stats.{c}_mean").alias("mean"), F.col(f"__stats.{c}_sd").alias("sd"),
        )
        for c in numeric
    ]))
    return (
        counts.select(rows.alias("r")).select("r.*")
        .filter(F.col("sd") > 0)
        .select("column_name", "outliers", rounded(F.col("mean")).alias("mean"), rounded(F.col("sd")).alias("sd"))
    )
