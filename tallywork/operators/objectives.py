"""Objective scores of trial tables: normalise, weigh, rank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions.numbers import rounded
from tallywork.operators.globalorder import with_position


@dataclass(frozen=True)
class Objective:
    """``metric`` is any SQL expression over the trial columns; default: the name itself."""

    name: str
    weight: float
    normalize: bool = True
    inverse: bool = False
    metric: str | None = None

    def value(self) -> Column:
        return F.coalesce(F.expr(self.metric or self.name).cast("double"), F.lit(0.0))

    def raw(self) -> Column:
        return F.expr(self.metric or self.name).cast("double")


# The default objectives and weights.
DEFAULT_OBJECTIVES = (
    Objective("accuracy", 0.6),
    Objective("tests", 0.2),
    Objective("cost", 0.1, inverse=True),
    Objective("latency", 0.1, inverse=True),
)
FLAT_RANGE = 1e-9


def score_column(name: str) -> str:
    return f"{name}_score"


def objective_scores(
    trials: DataFrame, objectives: Sequence[Objective], population: Sequence[str] = (), invert: bool = True
) -> DataFrame:
    """``trials`` plus one score column per objective.

    Min-max to [0, 1] within each population (NULL metrics score as 0 but do not bound the
    range); fewer than two values stay raw, a flat range gives 1. Minimised objectives are
    inverted. The bounds come from one aggregation joined back, so a hot population is
    never gathered in a window.
    """
    bounded = [o for o in objectives if o.normalize]
    scored = trials
    if bounded:
        aggregates = [
            a for o in bounded for a in (
                F.min(o.raw()).alias(f"__lo_{o.name}"), F.max(o.raw()).alias(f"__hi_{o.name}"),
                F.count(o.raw()).alias(f"__n_{o.name}"),
            )
        ]
        if population:
            bounds = trials.groupBy(*population).agg(*aggregates)
            same = [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in population]
            condition = same[0]
            for more in same[1:]:
                condition = condition & more
            joined = trials.alias("t").join(bounds.alias("b"), condition, "left")
            scored = joined.select("t.*", *[c for c in bounds.columns if c not in population])
        else:
            names = [f"__{k}_{o.name}" for o in bounded for k in ("lo", "hi", "n")]
            stats = trials.agg(*aggregates).select(F.struct(*names)).scalar()
            scored = trials.withColumn("__b", stats).select(*trials.columns, "__b.*")
    columns = []
    for o in objectives:
        score = o.value()
        if o.normalize:
            lo, hi, n = (F.col(f"__{k}_{o.name}") for k in ("lo", "hi", "n"))
            span = hi - lo
            clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - lo) / span))
            score = F.when(n < 2, score).when(span < FLAT_RANGE, F.lit(1.0)).otherwise(clipped)
        if o.inverse and invert:
            score = 1 - score
        columns.append(score.alias(score_column(o.name)))
    return scored.select(*trials.columns, *columns)


def weighted_score(objectives: Sequence[Objective]) -> Column:
    """Σ weight·score / Σ weight; a missing score counts as 0, no weight at all gives 0."""
    weight = sum(o.weight for o in objectives)
    if weight <= 0:
        return F.lit(0.0)
    terms = [F.coalesce(F.col(score_column(o.name)), F.lit(0.0)) * o.weight for o in objectives]
    return sum(terms[1:], terms[0]) / weight


def generation_stats(trials: DataFrame, objectives: Sequence[Objective], generation: str = "generation") -> DataFrame:
    """``trials`` with score columns and ``weighted_score``."""
    aggregates = []
    for o in objectives:
        score = F.coalesce(F.col(score_column(o.name)), F.lit(0.0))
        aggregates += [
            rounded(F.max(score)).alias(f"best_{o.name}"), rounded(F.avg(score)).alias(f"mean_{o.name}")
        ]
    return trials.groupBy(generation).agg(
        F.count(F.lit(1)).alias("population_size"),
        rounded(F.max("weighted_score")).alias("best_weighted_score"),
        rounded(F.avg("weighted_score")).alias("mean_weighted_score"),
        rounded(F.stddev_pop("weighted_score")).alias("std_weighted_score"),
        *aggregates,
    ).orderBy(generation)


def elites(
    trials: DataFrame, key: str, population_size: int, generation: str = "generation"
) -> DataFrame:
    """Per generation the best max(1, population_size // 4) trials (all, if there are fewer).

    Ranks come from the distributed order, for any size: no generation is gathered in one task.
    """
    kept = max(1, population_size // 4)
    best_first = [F.col("weighted_score").desc_nulls_last(), F.col(key)]
    return with_position(trials, best_first, "rank", [generation]).filter(F.col("rank") <= kept)


def best_trial(trials: DataFrame, key: str) -> DataFrame:
    return trials.orderBy(F.col("weighted_score").desc_nulls_last(), key).limit(1)
