"""Multi-objective queries: the parts as trials, the customers by value.

A part stands for a trial of generation ``p_partkey % 8``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions.numbers import rounded
from tallywork.operators import objectives as ob
from tallywork.operators import orderfacts as of
from tallywork.operators import skyline
from tallywork.operators.orderfacts import order_facts
from tallywork.plans.registry import query
from tallywork.sources.star import Star

OBJECTIVES = ob.DEFAULT_OBJECTIVES
SCORES = [ob.score_column(o.name) for o in OBJECTIVES]
POPULATION = 16


def _trials(star: Star) -> DataFrame:
    return star.table("part").select(
        F.col("p_partkey").alias("trial_id"),
        (F.col("p_partkey") % 8).alias("generation"),
        (F.col("p_size") / F.lit(50.0)).alias("accuracy"),
        (F.length("p_name") % 5 / F.lit(4.0)).alias("tests"),
        F.col("p_retailprice").alias("cost"),
        (F.length("p_type") * F.lit(0.25)).alias("latency"),
    )


def _scored(star: Star) -> DataFrame:
    scored = ob.objective_scores(_trials(star), OBJECTIVES, ["generation"])
    return scored.withColumn("weighted_score", ob.weighted_score(OBJECTIVES))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("trial_id", "generation", *[rounded(F.col(c)).alias(c) for c in columns])


@query()
def minmax_normalise(star: Star) -> DataFrame:
    normalised = ob.objective_scores(_trials(star), OBJECTIVES, ["generation"], invert=False)
    return _rounded(normalised, *SCORES)


@query()
def objective_scores(star: Star) -> DataFrame:
    return _rounded(ob.objective_scores(_trials(star), OBJECTIVES, ["generation"]), *SCORES)


@query()
def weighted_score(star: Star) -> DataFrame:
    return _rounded(_scored(star), "weighted_score")


@query()
def pareto_frontier(star: Star) -> DataFrame:
    return _rounded(skyline.pareto_frontier(_scored(star), SCORES), *SCORES)


@query()
def pareto_frontier_customers(star: Star) -> DataFrame:
    """Customers best by orders, revenue and recency."""
    per_customer = order_facts(star, ["order_date"], ["revenue"]).groupBy("customer_id").agg(
        F.count("order_id").alias("orders"),
        of.revenue().alias("revenue"),
        (-F.datediff(F.lit(star.as_of()), F.max("order_date"))).cast("long").alias("recency"),
    )
    return skyline.pareto_frontier(per_customer, ["orders", "revenue", "recency"])


@query()
def pareto_archive(star: Star) -> DataFrame:
    """Seven generations as a stored frontier, and the eighth inserted."""
    scored = _scored(star)
    stored = skyline.insert_generation(scored.filter("generation < 6"), scored.filter("generation = 6"), SCORES)
    archive = skyline.pareto_archive(stored, scored.filter("generation = 7"), SCORES, "trial_id")
    return _rounded(archive, *SCORES, "weighted_score")


@query()
def generation_stats(star: Star) -> DataFrame:
    return ob.generation_stats(_scored(star), OBJECTIVES)


@query()
def elites(star: Star) -> DataFrame:
    best = ob.elites(_scored(star), "trial_id", POPULATION)
    return best.select("generation", "rank", "trial_id", rounded(F.col("weighted_score")).alias("weighted_score"))


@query()
def best_trial(star: Star) -> DataFrame:
    return _rounded(ob.best_trial(_scored(star), "trial_id"), "weighted_score")
