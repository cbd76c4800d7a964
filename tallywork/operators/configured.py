"""Jobs that the evaluation settings describe: splits, budgets, latency and error reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.operators.globalorder import running_total

# Split shares in percent, budgets and the share at which they alert.
SPLIT = (("train", 70), ("val", 15), ("test", 15))
SEED = 42
MAX_TOKENS_PER_QUERY, MAX_TOTAL_TOKENS = 4000, 500000
MAX_SECONDS_PER_QUERY, MAX_TOTAL_SECONDS = 30.0, 600.0
ALERT_SHARE = 0.8


def split_train_val_test(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """``split`` by a hash of key and seed: the same row always lands in the same split."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    split, upper = None, 0
    for name, share in SPLIT[:-1]:
        upper += share
        split = F.when(bucket < upper, name) if split is None else split.when(bucket < upper, name)
    return df.withColumn("split", split.otherwise(SPLIT[-1][0]))


def _state(used: Column, budget: float) -> Column:
    return F.when(used > budget, "exceeded").when(used >= ALERT_SHARE * budget, "alert").otherwise("ok")


def budget_check(
    results: DataFrame, by: Sequence[str], max_tokens: float = MAX_TOKENS_PER_QUERY,
    max_total_tokens: float = MAX_TOTAL_TOKENS, max_seconds: float = MAX_SECONDS_PER_QUERY,
    max_total_seconds: float = MAX_TOTAL_SECONDS,
) -> DataFrame:
    """Queries over budget and the state of the totals, per group."""
    summed = results.groupBy(*by).agg(
        F.count_if(F.col("tokens") > max_tokens).alias("queries_over_tokens"),
        F.count_if(F.col("latency") > max_seconds).alias("queries_over_seconds"),
        F.sum("tokens").alias("total_tokens"),
        F.sum(F.col("latency").cast("decimal(18,6)")).cast("double").alias("total_seconds"),
    )
    return summed.select(
        "*",
        _state(F.col("total_tokens"), max_total_tokens).alias("tokens_state"),
        _state(F.col("total_seconds"), max_total_seconds).alias("seconds_state"),
    )


def latency_distribution(
    results: DataFrame, by: str, value: str, percents: Sequence[int] = (50, 90, 95, 99)
) -> DataFrame:
    """Exact percentiles per group: the value at position ⌈n·p/100⌉ of the sorted group.

    Equal values are counted first; the running count over the distinct values, in the distributed global
    order, tells which value fills a position. No group is gathered anywhere; NULL is a group.
    """
    counted = results.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(counted, [F.col(value)], F.col("n"), "upto", [by])
    sizes = placed.groupBy(F.col(by).alias("of")).agg(F.sum("n").alias("total"))
    wanted = F.array(*[
        F.struct(F.lit(p).alias("percentile"), F.ceil(F.col("total") * p / 100).cast("long").alias("position"))
        for p in percents
    ])
    filled = F.filter(wanted, lambda w: w["position"].between(F.col("upto") - F.col("n") + 1, F.col("upto")))
    return placed.join(sizes, F.col(by).eqNullSafe(F.col("of"))).select(by, value, F.explode(filled).alias("w")).select(
        by, "w.percentile", F.col(value).alias("latency")
    )


def error_taxonomy(traces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Failures per class of error."""
    error = F.lower("error")

    def mentions(*texts: str) -> Column:
        found = F.contains(error, F.lit(texts[0]))
        for text in texts[1:]:
            found = found | F.contains(error, F.lit(text))
        return found

    kind = (
        F.when(mentions("group by"), "missing_group_by")
        .when(mentions("ambiguous"), "ambiguous_column")
        .when(mentions("does not exist", "unknown"), "unknown_identifier")
        .otherwise("other")
    )
    failed = traces.filter(~F.coalesce("passed", F.lit(False)))
    return failed.groupBy(*by, kind.alias("error_class")).agg(F.count(F.lit(1)).alias("failures"))
