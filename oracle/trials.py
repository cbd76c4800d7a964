"""Multi-objective trial analytics."""

from oracle.common import AS_OF, FACT

OBJECTIVES = {"accuracy": (0.6, False), "tests": (0.2, False), "cost": (0.1, True), "latency": (0.1, True)}
SCORES = [f"{o}_score" for o in OBJECTIVES]
TRIALS = """trials AS (SELECT p_partkey AS trial_id, p_partkey % 8 AS generation, p_size / CAST(50 AS DOUBLE) AS accuracy,
  (length(p_name) % 5) / CAST(4 AS DOUBLE) AS tests, p_retailprice AS cost,
  length(p_type) * CAST(0.25 AS DOUBLE) AS latency FROM part)"""


def normal(o: str) -> str:
    lo, hi = f"min({o}) OVER g", f"max({o}) OVER g"
    return f"""CASE WHEN count({o}) OVER g < 2 THEN {o} WHEN {hi} - {lo} < 1e-9 THEN 1.0
      ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ({o} - {lo}) / ({hi} - {lo}))) END"""


NORMAL = f"""{TRIALS}, normal AS (SELECT *, {', '.join(f'{normal(o)} AS {o}_score' for o in OBJECTIVES)}
  FROM trials WINDOW g AS (PARTITION BY generation))"""
SCORED = f"""{NORMAL}, graded AS (SELECT trial_id, generation, {', '.join(
    f"{'1 - ' if inverse else ''}{o}_score AS {o}_score" for o, (_, inverse) in OBJECTIVES.items())} FROM normal),
  scored AS (SELECT *, ({' + '.join(f'{o}_score * CAST({w} AS DOUBLE)' for o, (w, _) in OBJECTIVES.items())})
    / CAST({sum(w for w, _ in OBJECTIVES.values())!r} AS DOUBLE) AS weighted_score FROM graded)"""


def shown(*columns: str) -> str:
    return "trial_id, generation, " + ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def frontier(source: str, columns: list[str]) -> str:
    reach = " AND ".join(f"b.{c} >= a.{c}" for c in columns)
    beat = " OR ".join(f"b.{c} > a.{c}" for c in columns)
    return f"SELECT * FROM {source} a WHERE NOT EXISTS (SELECT 1 FROM {source} b WHERE {reach} AND ({beat}))"


SQL = {
    "minmax_normalise": f"WITH {NORMAL} SELECT {shown(*SCORES)} FROM normal",
    "objective_scores": f"WITH {SCORED} SELECT {shown(*SCORES)} FROM scored",
    "weighted_score": f"WITH {SCORED} SELECT {shown('weighted_score')} FROM scored",
    "pareto_frontier": f"WITH {SCORED} SELECT {shown(*SCORES)} FROM ({frontier('scored', SCORES)})",
    "pareto_frontier_customers": f"""WITH {FACT}, c AS (SELECT customer_id, COUNT(DISTINCT order_id) AS orders,
      CAST(SUM(revenue) AS DOUBLE) AS revenue, -date_diff('day', MAX(order_date), {AS_OF}) AS recency
      FROM fact GROUP BY 1) {frontier('c', ['orders', 'revenue', 'recency'])}""",
    "pareto_archive": f"""WITH {SCORED} SELECT {shown(*SCORES, 'weighted_score')} FROM (
      SELECT * FROM ({frontier('scored', SCORES)}) ORDER BY weighted_score DESC, trial_id LIMIT 20)""",
    "generation_stats": f"""WITH {SCORED} SELECT generation, COUNT(*) AS population_size,
      round(max(weighted_score), 6) AS best_weighted_score, round(avg(weighted_score), 6) AS mean_weighted_score,
      round(stddev_pop(weighted_score), 6) AS std_weighted_score,
      {', '.join(f'round(max({o}_score), 6) AS best_{o}, round(avg({o}_score), 6) AS mean_{o}' for o in OBJECTIVES)}
      FROM scored GROUP BY 1""",
    "elites": f"""WITH {SCORED} SELECT generation, CAST(rank AS BIGINT) AS rank, trial_id, round(weighted_score, 6) AS weighted_score FROM (
      SELECT *, row_number() OVER (PARTITION BY generation ORDER BY weighted_score DESC, trial_id) AS rank FROM scored)
      WHERE rank <= 4""",
    "best_trial": f"WITH {SCORED} SELECT {shown('weighted_score')} FROM scored ORDER BY scored.weighted_score DESC, trial_id LIMIT 1",
}
