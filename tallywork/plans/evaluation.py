"""Scores of queries, KPIs and approaches."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallywork.functions import lint, text
from tallywork.functions.numbers import ratio, rounded
from tallywork.operators.compare import TOLERANCE, compare_results

# Weights of the scores and the price per token.
EXECUTION_WEIGHT, STATIC_WEIGHT = 0.7, 0.3
KPI_EXECUTION_WEIGHT, KPI_PROPERTY_WEIGHT = 0.6, 0.4
CORRECT_ABOVE = 0.7
PRICE_PER_TOKEN = 0.001 / 1000

#: What a query may raise while it is planned or run.
FAILURES = (PySparkException, Py4JJavaError)

SECONDS = "decimal(18,6)"  # summed exactly, to the microsecond


def _reason(error: Exception) -> str:
    """The error's condition, without the text that varies."""
    return (isinstance(error, PySparkException) and error.getCondition()) or type(error).__name__


def evaluate_query(
    spark: SparkSession, task_id: str, generated_sql: str, gold_sql: str | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row for one generated query, run now against the gold query on the session's views.

    Whatever the query raises, planned or running, scores 0 and leaves other tasks alone. The outcome of
    a comparison is one row, so it is kept as a literal. ``latency`` is the time of the comparison in seconds. Each
    answer is a job of its own, run at once: meant for tens of answers, whose tables may be of any size.
    """
    row, began = (False, 0.0, "No gold SQL provided"), time.perf_counter()
    if gold_sql:
        try:
            row = tuple(compare_results(spark.sql(generated_sql), spark.sql(gold_sql), tolerance).first())
        except FAILURES as error:
            row = (False, 0.0, f"Execution error: {_reason(error)}")
    row = (*row, time.perf_counter() - began)
    outcome = spark.createDataFrame([row], "passed boolean, score double, message string, latency double")
    static_ok = F.size("static_issues") == 0
    static_share = F.when(static_ok, F.lit(1.0)).otherwise(F.lit(0.5))
    return (
        outcome.withColumnsRenamed({"passed": "execution_match", "score": "execution_score", "message": "execution_message"})
        .withColumn("static_issues", lint.issues(F.lit(generated_sql)))
        .select(
            F.lit(task_id).alias("task_id"),
            (F.col("execution_match") & static_ok).alias("passed"),
            (F.col("execution_score") * EXECUTION_WEIGHT + static_share * STATIC_WEIGHT).alias("score"),
            "execution_match",
            static_ok.alias("static_checks_passed"),
            (text.word_count(F.lit(generated_sql)) * 2).alias("token_cost"), "latency",
            "execution_score", "execution_message", "static_issues",
        )
    )


def kpi_properties(
    result: DataFrame, properties: Sequence[str], bounds: tuple[float, float] | None = None
) -> DataFrame:
    """``property, passed`` for the first column of a measure's result.

    ``positive`` means no value below zero and none missing; ``range`` holds trivially
    unless ``bounds`` are given; unknown properties hold. An empty result fails them all.
    """
    value = F.col(result.columns[0])
    tests: dict[str, Column] = {
        "positive": F.coalesce(value >= 0, F.lit(False)),
        "not_null": value.isNotNull(),
    }
    if bounds:
        tests["range"] = F.coalesce(value.between(*bounds), F.lit(False))
    holds = F.lit(True)
    counted = result.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~tests.get(p, holds)).alias(f"broken_{i}") for i, p in enumerate(properties)],
    )
    rows = [
        F.struct(
            F.lit(p).alias("property"),
            ((F.col("rows") > 0) & (F.col(f"broken_{i}") == 0)).alias("passed"),
        )
        for i, p in enumerate(properties)
    ]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def evaluate_kpi(
    spark: SparkSession, task_id: str, measure: Callable[[], DataFrame], properties: Sequence[str],
    measure_sql: str = "",
) -> DataFrame:
    """One row for one measure: 0.6 for running, 0.4 for the share of properties that hold.

    The measure runs now; whatever it raises counts as not run, with no property held. ``measure_sql`` is its text, for
    the token cost; ``latency`` is the time it took in seconds.
    """
    counts, executed, began = (0, len(properties)), True, time.perf_counter()
    try:
        result = measure()
        if properties:
            held = kpi_properties(result, properties).agg(F.count_if("passed"), F.count(F.lit(1)))
            counts = tuple(held.first())
        else:
            result.write.format("noop").mode("overwrite").save()
    except FAILURES:
        executed = False
    held = spark.createDataFrame([(*counts, time.perf_counter() - began)], "held long, total long, latency double")
    share = F.col("held") / F.greatest(F.col("total"), F.lit(1)).cast("double")
    ran = F.lit(executed)
    return held.select(
        F.lit(task_id).alias("task_id"),
        (ran & (F.col("held") == F.col("total"))).alias("passed"),
        (F.lit(KPI_EXECUTION_WEIGHT if executed else 0.0) + share * KPI_PROPERTY_WEIGHT).alias("score"),
        ran.alias("execution_match"),
        (F.col("held") == F.col("total")).alias("static_checks_passed"),
        (text.word_count(F.lit(measure_sql)) * 2).alias("token_cost"), "latency",
    )


def suite_report(spark: SparkSession, tasks: Mapping[str, Callable[[], DataFrame] | None]) -> DataFrame:
    """Row counts of all gold queries, run now; one that fails, or a task without one, is reported, not raised."""
    rows = []
    for task_id, run in tasks.items():
        if run is None:
            rows.append((task_id, False, None, "No gold SQL provided"))
            continue
        try:
            # All columns are computed, not just the rows counted, so that an error anywhere shows.
            observed = Observation()
            run().observe(observed, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            rows.append((task_id, True, observed.get["rows"], None))
        except FAILURES as error:
            rows.append((task_id, False, None, _reason(error)))
    return spark.createDataFrame(rows, "task_id string, passed boolean, rows long, error string")


def suite_summary(report: DataFrame) -> DataFrame:
    total, passed = F.count(F.lit(1)), F.count_if("passed")
    return report.agg(
        total.alias("total"), passed.alias("passed"), (total - passed).alias("failed"),
        (ratio(passed, total) * 100).alias("pass_rate_pct"),
    )


def approach_summary(results: DataFrame, baseline: str) -> DataFrame:
    """Accuracy, cost and errors per approach, with differences to the baseline approach.

    ``results``: ``approach, score, tokens, latency, error``. Errors count against the
    accuracy but carry no tokens or time.
    """
    ok = F.col("error").isNull()
    total = F.count(F.lit(1))
    errors = F.count_if(~ok)
    answered = F.greatest(total - errors, F.lit(1))
    tokens = F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0))
    seconds = F.coalesce(F.sum(F.when(ok, F.col("latency").cast(SECONDS))).cast("double"), F.lit(0.0))
    summed = results.groupBy("approach").agg(
        total.alias("tasks"),
        (ratio(F.count_if(ok & (F.col("score") > CORRECT_ABOVE)), total) * 100).alias("accuracy_pct"),
        ratio(tokens, answered).alias("avg_tokens"),
        ratio(seconds, answered).alias("avg_latency"),
        errors.alias("errors"),
        rounded(tokens * F.lit(PRICE_PER_TOKEN), 9).alias("total_cost"),
    )
    base = summed.filter(F.col("approach") == baseline)
    base_accuracy = base.agg(F.max("accuracy_pct")).scalar()
    base_tokens = base.agg(F.max("avg_tokens")).scalar()
    return summed.select(
        "*",
        rounded(F.col("accuracy_pct") - base_accuracy).alias("accuracy_delta"),
        rounded((ratio(F.col("avg_tokens"), base_tokens) - 1) * 100).alias("tokens_delta_pct"),
    )


def genome_metrics(results: DataFrame, key: str = "genome_id") -> DataFrame:
    """Per trial: mean score, share of clean queries, mean tokens and latency."""
    clean = F.size(lint.issues(F.col("sql"))) == 0
    return results.groupBy(key).agg(
        rounded(F.avg("score")).alias("accuracy"),
        rounded(ratio(F.count_if(clean), F.count(F.lit(1)))).alias("tests"),
        ratio(F.sum("tokens"), F.count(F.lit(1))).alias("cost"),
        ratio(F.sum(F.col("latency").cast(SECONDS)), F.count("latency")).alias("latency"),
        F.count(F.lit(1)).alias("tasks_evaluated"),
        F.sum("tokens").alias("total_tokens"),
    )
