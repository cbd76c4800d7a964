"""Objective scores and frontiers, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.operators import objectives as ob
from tallywork.operators import skyline
from tests.conftest import rows


def brute(points):
    return {
        i for i, a in points.items()
        if not any(all(y >= x for x, y in zip(a, b)) and any(y > x for x, y in zip(a, b)) for b in points.values())
    }


def frame(spark, points):
    data = [(i, *map(float, p)) for i, p in points.items()]
    names = [f"s{k}" for k in range(len(next(iter(points.values()))))]
    return spark.createDataFrame(data, "id long, " + ", ".join(f"{n} double" for n in names)), names


@pytest.mark.parametrize("dims, levels, round_rows", [(2, 1000, 8192), (3, 8, 8192), (4, 5, 20), (3, 1000, 7)])
def test_frontier_is_exact(spark, dims, levels, round_rows):
    """Small rounds force several of them; few levels give many equal vectors."""
    rng = np.random.default_rng(dims * levels)
    points = dict(enumerate(rng.integers(0, levels, (400, dims)).tolist()))
    df, names = frame(spark, points)
    got = {r.id for r in skyline.pareto_frontier(df.repartition(5), names, round_rows).collect()}
    assert got == brute(points)


def test_everything_on_the_frontier(spark):
    points = {i: (i, 100 - i) for i in range(101)}
    df, names = frame(spark, points)
    assert skyline.pareto_frontier(df, names, 10).count() == 101


def test_frontier_of_frontier_and_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 0.5, None), (4, 2.0, -1.0)], "id long, a double, b double"
    )
    front = skyline.pareto_frontier(df, ["a", "b"])
    assert rows(front, "id") == [(1,), (2,), (4,)]
    assert rows(skyline.pareto_frontier(front, ["a", "b"]), "id") == [(1,), (2,), (4,)]
    assert skyline.pareto_frontier(df.limit(0), ["a", "b"]).count() == 0


def anti_correlated(n, dims, seed):
    """Points near a plane of constant sum: most are on the frontier."""
    rng = np.random.default_rng(seed)
    raw = rng.dirichlet(np.ones(dims), n) + rng.normal(0, 0.002, (n, dims))
    return np.round(raw, 6)


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_grid_is_exact_on_anti_correlated_rows(spark, dims, monkeypatch):
    monkeypatch.setattr(skyline, "CELL_ROWS", 16)
    rows_ = anti_correlated(1500, dims, dims)
    df, names = frame(spark, dict(enumerate(rows_.tolist())))
    got = {r.id for r in skyline.pareto_frontier(df.repartition(4), names, 60).collect()}
    assert got == set(np.flatnonzero(~skyline.dominated_by(rows_, rows_)).tolist()) and len(got) > 20


def test_fewer_than_quadratic_pairs_are_compared(spark):
    """Eight times the rows: 64 times the pairs would be quadratic; the grid's finer cells keep it well below."""
    compared = []
    for n in (4000, 32000):
        df, names = frame(spark, dict(enumerate(anti_correlated(n, 3, 5).tolist())))
        _, plan = skyline.grid_plan(df.select(*names), names)
        assert plan.compared < n * n / 3
        compared.append(plan.compared)
    assert compared[1] < 32 * compared[0]


def test_cells_that_meet():
    """On a 3 x 3 grid: the cell above both drops the lower left; the corners on the diagonal never meet."""
    plan = skyline.plan_grid({0: 9, 2: 5, 4: 3, 6: 4, 1: 2}, [3, 3])
    assert set(plan.against) == {2, 4, 6, 1} and plan.against[4] == [4] and plan.against[2] == [2]
    assert sorted(plan.against[1]) == [1, 2, 4]
    assert plan.compared == 5 * 5 + 3 * 3 + 4 * 4 + 2 * (2 + 5 + 3)
    assert skyline.plan_grid({}, [2, 2]).compared == 0


def test_no_comparable_value(spark):
    df = spark.createDataFrame([(1, float("nan"), 9.0), (2, 1.0, 1.0), (3, 0.0, 0.0), (4, float("inf"), 0.0)], "id long, a double, b double")
    assert rows(skyline.pareto_frontier(df, ["a", "b"]), "id") == [(1,), (2,), (4,)]


def test_archive_by_generations_is_the_frontier_of_all(spark):
    rng = np.random.default_rng(2)
    points = {i: p for i, p in enumerate(rng.integers(0, 30, (300, 3)).tolist())}
    df, names = frame(spark, points)
    archive = df.limit(0)
    for part in range(3):
        archive = skyline.insert_generation(archive, df.filter(F.col("id") % 3 == part), names)
    assert {r.id for r in archive.collect()} == brute(points)


A = ob.Objective("a", 3.0)
B = ob.Objective("b", 1.0, inverse=True)


def test_normalisation(spark):
    df = spark.createDataFrame(
        [(0, 1, 10.0, 5.0), (1, 1, 20.0, 5.0), (2, 1, None, 5.0), (3, 2, 7.0, 3.0)], "id int, g int, a double, b double"
    )
    out = {r.id: r for r in ob.objective_scores(df, [A, B], ["g"]).collect()}
    assert [out[i].a_score for i in range(3)] == [0.0, 1.0, 0.0]  # NULL scores as 0, clipped
    assert [out[i].b_score for i in range(3)] == [0.0, 0.0, 0.0]  # flat range: 1, inverted
    assert out[3].a_score == 7.0 and out[3].b_score == -2.0       # alone: raw
    whole = {r.id: r.a_score for r in ob.objective_scores(df, [A]).collect()}
    assert whole[3] == 0.0 and whole[1] == 1.0 and whole[0] == pytest.approx(3 / 13)


def test_weighted_score_and_expression_metric(spark):
    raw = ob.Objective("x", 1.0, normalize=False, metric="a * 2")
    df = spark.createDataFrame([(1.5,), (None,)], "a double")
    out = ob.objective_scores(df, [raw]).withColumn("w", ob.weighted_score([raw, raw]))
    assert [r.w for r in out.collect()] == [3.0, 0.0]
    scored = spark.createDataFrame([(0.5, None)], "a_score double, b_score double")
    assert scored.select(ob.weighted_score([A, B]).alias("w")).first().w == pytest.approx(1.5 / 4)
    assert spark.range(1).select(ob.weighted_score([]).alias("w")).first().w == 0.0


def test_elites_and_best(spark):
    df = spark.range(20).select(
        F.col("id"), (F.col("id") % 2).alias("generation"), (F.col("id") / 10.0).alias("weighted_score")
    )
    assert rows(ob.elites(df, "id", 8), "generation", "rank", "id") == [(0, 1, 18), (0, 2, 16), (1, 1, 19), (1, 2, 17)]
    assert ob.elites(df, "id", 2).count() == 2  # at least one each
    assert ob.best_trial(df, "id").first().id == 19


def test_many_elites_of_one_generation(spark):
    """One path for every size; ties go by the key."""
    df = spark.range(5000).select(
        F.col("id"), F.lit(0).alias("generation"), (F.col("id") % 10 / 10.0).alias("weighted_score")
    )
    got = rows(ob.elites(df, "id", 4800), "rank", "id")
    want = sorted(range(5000), key=lambda i: (-(i % 10), i))[:1200]
    assert got == sorted(enumerate(want, 1), key=repr)


def test_archive_keeps_the_best(spark):
    df = spark.createDataFrame([(i, float(i), float(50 - i), float(i % 7)) for i in range(50)],
                               "id long, a double, b double, weighted_score double")
    kept = skyline.pareto_archive(df.filter("id < 25"), df.filter("id >= 25"), ["a", "b"], "id", archive_size=3)
    assert [r.id for r in kept.collect()] == [6, 13, 20, 27, 34, 41]
