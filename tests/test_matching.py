"""Rows matched within a tolerance against the largest matching by exhaustive search."""

import random

import numpy as np
import pytest

from tallywork.operators import compare
from tallywork.operators import matching as mt


def largest(got, want, near):
    """Kuhn's algorithm, row by row."""
    taken = {}

    def place(i, seen):
        for j in range(len(want)):
            if j not in seen and near(got[i], want[j]):
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(got)))


def close(a, b, tolerance=0.001):
    def same(x, y):
        if isinstance(x, float) or isinstance(y, float):
            gone = [v is None or v != v for v in (x, y)]
            return all(gone) if any(gone) else x == y or abs(x - y) <= tolerance
        return x == y

    return all(same(x, y) for x, y in zip(a, b))


def counted(spark, got, want, schema):
    row = mt.matched_rows(spark.createDataFrame(got, schema).repartition(4), spark.createDataFrame(want, schema)).first()
    assert (row.got_rows, row.want_rows) == (len(got), len(want))
    return row.matched


@pytest.mark.parametrize("columns", [1, 2, 4])
def test_largest_matching(spark, columns):
    """Values on a fine grid, so that chains stretch far beyond the tolerance; copies, nulls, NaN and infinity among them."""
    random.seed(columns)

    def value():
        return random.choice([None, float("nan"), float("inf")] + [random.randint(0, 14) * 0.00037 for _ in range(12)])

    def table(n):
        return [(random.choice(["a", "b", None]), *[value() for _ in range(columns)]) for _ in range(n)]

    got, want = table(70), table(60)
    got += [got[0]] * 4
    want += [got[0]] * 2
    schema = "k string, " + ", ".join(f"v{i} double" for i in range(columns))
    assert counted(spark, got, want, schema) == largest(got, want, close)


def test_noise_in_the_first_column(spark):
    """The copy scores 1 here, though sorting it puts its rows in another order."""
    random.seed(2)
    rows = [(random.randint(0, 9) * 0.0001, i, f"n{i % 5}", random.choice([1.5, None])) for i in range(400)]
    noisy = [(a + random.uniform(-0.0009, 0.0009), i, n, v) for a, i, n, v in rows]
    schema = "a double, i int, n string, v double"
    got, want = spark.createDataFrame(noisy, schema), spark.createDataFrame(rows, schema)
    assert mt.row_match_score(got, want).first()["score"] == 1.0
    assert compare.cell_match_score(got, want).first()["score"] < 1.0


def test_shapes(spark):
    schema = "k int, v double"
    assert counted(spark, [], [], schema) == 0 and counted(spark, [(1, 1.0)], [], schema) == 0
    assert counted(spark, [(1, 2.0), (1, None)], [(1, 2.0), (1, 0.0)], schema) == 1
    some, other = spark.createDataFrame([(1, 1.0)], schema), spark.createDataFrame([(1, 1.0)], "k int, w double")
    assert tuple(mt.matched_rows(some, other).first()) == (1, 1, 0)
    whole = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, s string")
    assert tuple(mt.matched_rows(whole, whole.limit(2)).first())[2] == 2
    assert mt.row_match_score(some.limit(0), some.limit(0)).first()["score"] == 1.0


def test_matchings_by_themselves():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, m = rng.integers(1, 9, 2)
        a, b = np.sort(rng.integers(0, 12, n) * 0.4), np.sort(rng.integers(0, 12, m) * 0.4)
        copies = rng.integers(1, 4, n), rng.integers(1, 4, m)
        rows = [np.repeat(side, k).tolist() for side, k in zip((a, b), copies)]
        want = largest(*rows, lambda x, y: abs(x - y) <= 1)
        near = np.abs(a[:, None] - b[None, :]) <= 1
        assert mt.along_line(a, b, *copies, 1.0) == mt.at_best(near, *copies) == want
        assert mt._in_order(a[:, None], b[:, None], *copies, 1.0) <= want


def test_settled_groups_are_only_counted(spark, monkeypatch):
    """Groups that lie together or apart need no copy of the rows in the shared folder, and no global order."""
    def refuse(*_):
        raise AssertionError("rows were stored or sorted")

    for name in ("materialise", "with_previous", "running_total"):
        monkeypatch.setattr(mt, name, refuse)
    want = [(i // 2, i % 2, 10.0 * i, 0.5) for i in range(300)]
    got = [(k, n, a + (i % 3) * 0.0004, b + (1.0 if i % 7 == 0 else 0.0)) for i, (k, n, a, b) in enumerate(want)]
    assert counted(spark, got, want, "k int, n int, a double, b double") == sum(i % 7 != 0 for i in range(300))


@pytest.mark.parametrize("best", [4, 1024])
def test_open_groups_of_few_and_of_many_rows(spark, monkeypatch, best):
    """Chains wider than the tolerance in groups of three sizes, matched in one task or along the global order."""
    monkeypatch.setattr(mt, "BEST_ROWS", best)
    random.seed(best)
    sides = [[(k, 1.0 * n + random.randint(0, 9) * 0.0004) for k, size in (("a", 2), ("b", 5), (None, 30)) for n in range(size) for _ in range(3)]
             for _ in range(2)]
    assert counted(spark, *sides, "k string, v double") == largest(*sides, close)
