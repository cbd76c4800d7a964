"""Running totals and result comparison against brute force."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tallywork.operators import compare
from tallywork.operators.globalorder import running_total, with_position


def test_running_total_over_many_partitions(spark):
    values = [(i, random.Random(7).randint(-5, 50) + i % 13) for i in range(5000)]
    df = spark.createDataFrame(values, "id long, v long").repartition(7)
    out = running_total(df, [F.col("v").desc(), F.col("id")], F.col("v"), "total")
    ordered = sorted(values, key=lambda r: (-r[1], r[0]))
    want = {i: t for (i, _), t in zip(ordered, accumulate(v for _, v in ordered))}
    assert {r.id: r.total for r in out.collect()} == want


def test_hot_group_spans_partitions(spark):
    data = [("hot" if i % 3 else f"g{i % 50}", i) for i in range(3000)] + [(None, i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, i long").repartition(5)
    out = with_position(df, [F.col("i")], "position", ["g"])
    seen = {}
    for row in sorted(out.collect(), key=lambda r: (str(r.g), r.i)):
        seen[row.g] = seen.get(row.g, 0) + 1
        assert row.position == seen[row.g]
    assert sum(seen.values()) == 3200


SCHEMA = "k long, name string, v double"
BASE = [(1, "a", 1.0), (2, "b", 2.0), (3, None, None), (4, "d", 4.0)]


def outcome(spark, got, want, got_schema=SCHEMA, want_schema=SCHEMA):
    a = spark.createDataFrame(got, got_schema)
    b = spark.createDataFrame(want, want_schema)
    return tuple(compare.compare_results(a, b).first())


def test_shuffled_rows_and_columns_match(spark):
    swapped = [(v, k, n) for k, n, v in reversed(BASE)]
    got = outcome(spark, BASE, swapped, want_schema="v double, k long, name string")
    assert got == (True, 1.0, "Match score: 1.000")


def test_tolerance(spark):
    near = [(k, n, None if v is None else v + 0.0005) for k, n, v in BASE]
    far = [(k, n, None if v is None else v + 0.002) for k, n, v in BASE]
    assert outcome(spark, near, BASE)[0] is True
    assert outcome(spark, far, BASE) == (False, pytest.approx(9 / 12), "Match score: 0.750")


def test_pass_mark_is_95_percent(spark):
    many = [(i, str(i), float(i)) for i in range(20)]
    three_off = [(i, str(i), float(i) + (1.0 if i > 16 else 0.0)) for i in range(20)]
    four_off = [(i, str(i), float(i) + (1.0 if i > 15 else 0.0)) for i in range(20)]
    assert outcome(spark, three_off, many)[:2] == (True, pytest.approx(0.95))
    assert outcome(spark, four_off, many)[0] is False


def test_other_shapes(spark):
    assert outcome(spark, [], [])[:2] == (True, 1.0)
    assert outcome(spark, [], BASE)[:2] == (False, 0.0)
    assert outcome(spark, BASE + BASE[:1], BASE) == (False, 0.6, "Row count mismatch: 5 vs 4")
    renamed = "k long, title string, v double"
    assert outcome(spark, BASE, BASE, want_schema=renamed)[:2] == (False, 0.5)
    assert outcome(spark, [], [], want_schema=renamed)[:2] == (True, 1.0)


def test_against_brute_force(spark, monkeypatch):
    """Random tables with many copies, small blocks: cell for cell as sorting both sides says."""
    monkeypatch.setattr(compare, "BLOCK_ROWS", 16)
    rng = random.Random(3)
    for _ in range(3):
        got = [(rng.randint(0, 3), rng.choice("ab"), float(rng.randint(0, 2))) for _ in range(200)]
        want = [(rng.randint(0, 3), rng.choice("ab"), float(rng.randint(0, 2))) for _ in range(200)]
        pairs = zip(sorted(got), sorted(want))
        matching = sum(x == y for a, b in pairs for x, y in zip(a, b))
        a, b = spark.createDataFrame(got, SCHEMA), spark.createDataFrame(want, SCHEMA)
        assert compare.cell_matches(a, b).first() == (200, 200, matching)
        assert compare.cell_match_score(a, b).first().score == pytest.approx(matching / 600)


def test_hot_row_is_split_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK_ROWS", 10)
    got = spark.range(1000).select(F.lit(5).alias("x"))
    want = spark.range(1000).select(F.when(F.col("id") < 400, 4).otherwise(5).alias("x"))
    assert compare.cell_matches(got, want).first() == (1000, 1000, 600)


def test_kinds_must_agree(spark):
    got = outcome(spark, [(1, "1", 1.0)], [(1, 1, 1.0)], want_schema="k long, name long, v double")
    assert got[1] == pytest.approx(2 / 3)
