"""Roll-ups at every subset of a grain against plain counting."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallywork.operators import lattice
from tests.conftest import rows

GRAIN = ("a", "b", "c")


def facts_of(n, seed):
    random.seed(seed)
    pick = random.choice
    return [
        (pick(["x", "y", None]), pick([1, 2, 3, 4, None]), pick("pqr"), pick([None, -5, 0, 1, 32768, 32769, *range(40000, 40200)]), pick([1, 2, None]))
        for _ in range(n)
    ]


def plain(data):
    out = []
    for size in range(4):
        for keys in itertools.combinations(range(3), size):
            groups = {}
            for row in data:
                groups.setdefault(tuple(row[k] if k in keys else None for k in range(3)), []).append(row)
            if not keys and not data:
                groups[(None,) * 3] = []
            level = sum(4 >> k for k in range(3) if k not in keys)
            for group, own in groups.items():
                added = [r[4] for r in own if r[4] is not None]
                out.append((level, *group, sum(added) if added else None, len({r[3] for r in own if r[3] is not None})))
    return sorted(out, key=repr)


@pytest.mark.parametrize("dense", [0, 3, 1e9])
@pytest.mark.parametrize("n", [0, 1, 700])
def test_every_level(spark, dense, n):
    """With bitmaps everywhere, in the coarse levels only, and nowhere."""
    data = facts_of(n, n)
    df = spark.createDataFrame(data, "a string, b int, c string, who bigint, v bigint")
    out = lattice.cube(df, GRAIN, ["v"], "who", [F.sum("v").alias("v")], dense)
    assert rows(out, "level", *GRAIN, "v", "members") == plain(data)


def test_smallest_parents():
    sizes = {keys: 10 ** len(keys) for keys in lattice.subsets(GRAIN)}
    sizes[("a", "b")], sizes[("b", "c")], sizes[()] = 50, 40, 1000
    bitmaps = {keys: max(1, size // 20) for keys, size in sizes.items()} | {(): 1}
    levels = lattice.plan_levels(GRAIN, sizes, bitmaps, dense=100)
    assert {k: level.parent for k, level in levels.items()} == {
        ("a", "b", "c"): None, ("a", "b"): GRAIN, ("a", "c"): GRAIN, ("b", "c"): GRAIN,
        ("a",): ("a", "b"), ("b",): ("b", "c"), ("c",): ("b", "c"), (): ("a",),
    }
    assert [k for k, level in levels.items() if level.bitmaps] == [()]
    dense = lattice.plan_levels(GRAIN, sizes, bitmaps, dense=20)
    assert not dense[GRAIN].bitmaps and all(dense[k].bitmaps for k in [("a", "b"), ("b",), ()])


def test_lines_are_read_once(spark, star):
    from tallywork.plans import kpis

    text = kpis.kpis_at_all_grains(star, ("order_date", "region"))._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in text and "Expand" not in text
