"""All roll-ups of a grain, each from its smallest finished parent, with exact distinct counts.

A level of the lattice is a set of keys. Its table holds additive partial sums and the members that a distinct count
counts, in one of two forms that both merge exactly: a row per member, or one bitmap per group and bucket of 32,768
member numbers. A bitmap is 4 KB whatever it holds, so a level gets bitmaps only where they hold enough members each;
coarser levels of it follow with bitmaps. The facts are read once, for the finest level; estimates of all levels' sizes,
taken from it in one pass, choose parents and forms. Only levels that others are made from are stored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.session import materialise

#: Members per bitmap from which a bitmap is smaller than their rows.
DENSE = 128
BUCKET, BITS = "__bucket", "__bits"

Keys = tuple[str, ...]


@dataclass(frozen=True)
class Level:
    """How a level is made: from which one, and whether with bitmaps; ``rows`` is an estimate of its table."""

    keys: Keys
    parent: Keys | None
    bitmaps: bool
    rows: int


def subsets(grain: Sequence[str]) -> list[Keys]:
    """All sets of keys, larger ones first."""
    return [keys for size in range(len(grain), -1, -1) for keys in combinations(grain, size)]


def plan_levels(grain: Sequence[str], members: Mapping[Keys, int], bitmaps: Mapping[Keys, int], dense: float = DENSE) -> dict[Keys, Level]:
    """A level per set of keys, given how many member rows and how many bitmaps each would have."""
    levels = {tuple(grain): Level(tuple(grain), None, False, members[tuple(grain)])}
    for keys in subsets(grain)[1:]:
        parents = [levels[p] for p in levels if len(p) == len(keys) + 1 and set(keys) < set(p)]
        parent = min(parents, key=lambda level: (level.rows, level.keys))
        dense_enough = parent.bitmaps or members[keys] >= dense * bitmaps[keys]
        levels[keys] = Level(keys, parent.keys, dense_enough, bitmaps[keys] if dense_enough else members[keys])
    return levels


def _sizes(base: DataFrame, grain: Sequence[str], member: str) -> tuple[dict[Keys, int], dict[Keys, int]]:
    """Estimated member rows and bitmaps of every level, in one pass.

    A key is hashed once per row, whatever the number of levels; what is counted are combinations of these hashes.
    """
    all_keys = subsets(grain)
    lasts = {"m": F.col(member), "b": F.bitmap_bucket_number(F.col(member))}
    # Each hash has a number of its own in it, so that keys with equal values do not stand for each other.
    hashes = {key: F.xxhash64(F.lit(n), column) for n, (key, column) in enumerate([*[(k, F.col(k)) for k in grain], *lasts.items()])}
    hashed = base.select(*[h.alias(f"h{n}") for n, h in enumerate(hashes.values())])
    at = {key: F.col(f"h{n}") for n, key in enumerate(hashes)}
    counts = hashed.select(*[
        reduce(Column.bitwiseXOR, [at[k] for k in (*keys, kind)]).alias(f"{kind}{n}") for n, keys in enumerate(all_keys) for kind in lasts
    ]).agg(*[F.approx_count_distinct(f"{kind}{n}").alias(f"{kind}{n}") for n in range(len(all_keys)) for kind in lasts]).first()
    return tuple({keys: counts[f"{kind}{n}"] for n, keys in enumerate(all_keys)} for kind in ("m", "b"))


def _rolled(parent: DataFrame, of: Level, level: Level, sums: Sequence[str], member: str) -> DataFrame:
    added = [F.sum(c).alias(c) for c in sums]
    if of.bitmaps:
        return parent.groupBy(*level.keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS), *added)
    if not level.bitmaps:
        return parent.groupBy(*level.keys, member).agg(*added)
    return parent.groupBy(*level.keys, F.bitmap_bucket_number(F.col(member)).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(member))).alias(BITS), *added
    )


def cube(
    facts: DataFrame, grain: Sequence[str], sums: Sequence[str], member: str, aggregates: Sequence[Column], dense: float = DENSE
) -> DataFrame:
    """One row per group of every subset of ``grain``: level, the keys, ``aggregates``, members.

    ``sums`` are the additive columns that the aggregates add up; ``member`` is a whole number, whose distinct values
    ``members`` counts, nulls aside. ``level`` has a bit per key, the first key's highest, set where the key is rolled up
    (and null); a null key elsewhere is a group of its own. Without facts only the level of no keys has a row.
    """
    base = materialise(facts.groupBy(*grain, member).agg(*[F.sum(c).alias(c) for c in sums]))
    levels = plan_levels(grain, *_sizes(base, grain, member), dense)
    parents = {level.parent for level in levels.values()}
    tables: dict[Keys, DataFrame] = {}
    result = None
    for keys, level in levels.items():
        table = base if level.parent is None else _rolled(tables[level.parent], levels[level.parent], level, sums, member)
        if level.parent is not None and keys in parents:
            table = materialise(table)
        tables[keys] = table
        members = F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)) if level.bitmaps else F.count(member)
        bits = sum(1 << (len(grain) - 1 - n) for n, key in enumerate(grain) if key not in keys)
        rows = table.groupBy(*keys).agg(*aggregates, members.cast("long").alias("members"))
        shown = rows.select(
            F.lit(bits).cast("long").alias("level"),
            *[F.col(k) if k in keys else F.lit(None).cast(base.schema[k].dataType).alias(k) for k in grain],
            *[c for c in rows.columns if c not in keys],
        )
        result = shown if result is None else result.unionByName(shown)
    return result
