"""How many rows of two tables match one to one, where fractional numbers may differ by a tolerance.

Sorting both tables and comparing position by position pairs wrong rows as soon as noise in one column changes the order.
Here rows only have to agree in their exact columns; within such a group the rows of both tables are cut, one fractional
column after the other, wherever neighbouring values lie more than the tolerance apart. No row can match across a cut.
One aggregation settles most groups: where all values lie within the tolerance everything matches, where the two sides lie
apart in some column nothing does. Of the others those of few rows are cut and matched in one task each; the neighbours and
cuts of larger ones come from the global order, so a group of any size spreads over tasks. Clusters that stretch further than
the tolerance are matched row by row: along the line for one fractional column, by augmenting paths for several.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallywork.operators.compare import FRACTIONAL, TOLERANCE, _plain, _same_names
from tallywork.operators.globalorder import running_total, with_previous
from tallywork.session import materialise, new_folder, ship_package

#: Fractional columns that clusters are cut by; all others are still compared.
CUT_COLUMNS = 3
#: Distinct rows of a stretched cluster up to which several fractional columns are matched at best, not in their order.
BEST_ROWS = 1024
TOTALS = ("got_rows", "want_rows", "matched")


def along_line(got: np.ndarray, want: np.ndarray, n_got: np.ndarray, n_want: np.ndarray, tolerance: float) -> int:
    """The most matches of sorted values with their copies: the lowest ones still open match or one of them never will."""
    i = j = matched = 0
    left, right = n_got.copy(), n_want.copy()
    while i < len(got) and j < len(want):
        if abs(got[i] - want[j]) <= tolerance:
            n = min(left[i], right[j])
            matched += int(n)
            left[i] -= n
            right[j] -= n
            i += left[i] == 0
            j += j < len(right) and right[j] == 0
        elif got[i] < want[j]:
            i += 1
        else:
            j += 1
    return matched


def at_best(near: np.ndarray, n_got: np.ndarray, n_want: np.ndarray) -> int:
    """The most matches where ``near[i, j]`` says which rows may match: augmenting paths, shortest first, with copies as capacities."""
    left, right = n_got.astype(int).tolist(), n_want.astype(int).tolist()
    flow = np.zeros(near.shape, int)
    matched = 0
    while True:
        came: dict[tuple[str, int], tuple[str, int] | None] = {("g", i): None for i, n in enumerate(left) if n}
        queue, end = deque(came), None
        while queue and end is None:
            side, k = queue.popleft()
            ways = [("w", j) for j in np.flatnonzero(near[k])] if side == "g" else [("g", i) for i in np.flatnonzero(flow[:, k])]
            for way in ways:
                if way not in came:
                    came[way] = (side, k)
                    queue.append(way)
                    if way[0] == "w" and right[way[1]]:
                        end = way
                        break
        if end is None:
            return matched
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        n = min(left[path[0][1]], right[end[1]], *[flow[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "w"])
        for a, b in zip(path, path[1:]):
            if a[0] == "g":
                flow[a[1], b[1]] += n
            else:
                flow[b[1], a[1]] -= n
        left[path[0][1]] -= n
        right[end[1]] -= n
        matched += n


def _stretched(columns: list[str], tolerance: float):
    def run(cluster: pd.DataFrame) -> pd.DataFrame:
        cluster = cluster.sort_values(columns, kind="stable")
        got, want = cluster[cluster["__got"] > 0], cluster[cluster["__want"] > 0]
        copies = got["__got"].to_numpy(), want["__want"].to_numpy()
        values = [side[columns].to_numpy(float) for side in (got, want)]
        if len(columns) > 1 and len(cluster) <= BEST_ROWS:
            near = (np.abs(values[0][:, None, :] - values[1][None, :, :]) <= tolerance).all(axis=2)
            matched = at_best(near, *copies)
        elif len(columns) > 1:
            matched = _in_order(*values, *copies, tolerance)
        else:
            matched = along_line(values[0][:, 0], values[1][:, 0], *copies, tolerance)
        return pd.DataFrame({"matched": [matched]})

    return run


def _small_group(columns: list[str], tolerance: float):
    """The matches of a whole group, cut along all its columns first."""
    match = _stretched(columns, tolerance)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group[[*columns, "__got", "__want"]].groupby(columns, as_index=False, dropna=False).sum().fillna(0.0)
        return pd.DataFrame({"matched": [sum(_cut_and_match(group, columns, 0, tolerance, match))]})

    return run


def _cut_and_match(rows: pd.DataFrame, columns: list[str], unbroken: int, tolerance: float, match) -> Iterator[int]:
    """Matches of the clusters of ``rows``, which the last ``unbroken`` columns tried do not cut."""
    got, want = rows["__got"].sum(), rows["__want"].sum()
    if not got or not want:
        return
    values = rows[columns].to_numpy(float)
    if ((values.max(axis=0) - values.min(axis=0)) <= tolerance).all():
        yield int(min(got, want))
    elif unbroken == len(columns):
        yield int(match(rows)["matched"].iloc[0])
    else:
        # Columns take turns, until none of them cuts any more.
        rows = rows.sort_values(columns[0], kind="stable")
        ends = np.flatnonzero(np.diff(rows[columns[0]].to_numpy(float)) > tolerance) + 1
        turned = [*columns[1:], columns[0]]
        for start, end in zip([0, *ends], [*ends, len(rows)]):
            yield from _cut_and_match(rows.iloc[start:end], turned, 0 if len(ends) else unbroken + 1, tolerance, match)


def _in_order(got: np.ndarray, want: np.ndarray, n_got: np.ndarray, n_want: np.ndarray, tolerance: float) -> int:
    """A matching that takes for each row the first open one within reach, along the first column."""
    right, matched, low = n_want.copy(), 0, 0
    for value, n in zip(got, n_got):
        while low < len(want) and want[low, 0] < value[0] - tolerance:
            low += 1
        high = int(np.searchsorted(want[:, 0], value[0] + tolerance, side="right"))
        for j in low + np.flatnonzero((right[low:high] > 0) & (np.abs(want[low:high] - value) <= tolerance).all(axis=1)):
            taken = min(n, right[j])
            right[j] -= taken
            matched += int(taken)
            n -= taken
            if not n:
                break
    return matched


def _number(column: str) -> Column:
    """A fractional value as DOUBLE, NaN as null."""
    return F.nullif(F.col(column).cast("double"), F.lit(float("nan")))


def matched_rows(got: DataFrame, want: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row: got_rows, want_rows, matched, for tables of the same columns.

    Rows match if all values do: fractional numbers (on both sides) within ``tolerance``, others equal; null and NaN match
    each other. Each row matches one at most and copies count each. The number is the largest possible, but for clusters
    of several fractional columns, wider than the tolerance, with over ``BEST_ROWS`` distinct rows: there it is that of a
    matching in order. Infinite values match only themselves. Tables with other column names match nothing.
    """
    spark = got.sparkSession
    ship_package(spark)
    named_alike = _same_names(got, want)
    got, want = _plain(got), _plain(want)
    kinds = [{f.name: f.dataType for f in side.schema.fields} for side in (got, want)]
    fractional = [c for c in got.columns if named_alike and all(isinstance(k[c], FRACTIONAL) for k in kinds)]
    if not named_alike:
        sides = [side.select(F.lit(n).alias("__got"), F.lit(1 - n).alias("__want")) for side, n in ((got, 1), (want, 0))]
        return sides[0].union(sides[1]).agg(
            *[F.coalesce(F.sum(f"__{s}"), F.lit(0)).alias(f"{s}_rows") for s in ("got", "want")], F.lit(0).cast("long").alias("matched")
        )
    exact = [c for c in got.columns if c not in fractional]
    same_kind = {c: kinds[0][c] == kinds[1][c] for c in exact}
    sides = []
    for side, n in ((got, 1), (want, 0)):
        plain = [F.col(c) if same_kind[c] else F.col(c).cast("string") for c in exact]
        infinite = [F.when(F.abs(_number(c)) == float("inf"), _number(c)) for c in fractional]
        key = F.struct(F.lit(0).alias("k"), *[p.alias(f"e{i}") for i, p in enumerate(plain)], *[
            v.alias(f"x{i}") for i, v in enumerate([*[_number(c).isNull() for c in fractional], *infinite])
        ])
        values = [F.when(F.abs(_number(c)) < float("inf"), _number(c)).alias(f"f{i}") for i, c in enumerate(fractional)]
        sides.append(side.select(key.alias("key"), *values, F.lit(n).alias("__got"), F.lit(1 - n).alias("__want")))
    names = [f"f{i}" for i in range(len(fractional))]
    both, seen, path = sides[0].union(sides[1]), Observation(), new_folder(spark, "open-groups")
    # Only the keys of groups that stay open are written; the totals are observed on the way.
    groups = both.groupBy("key").agg(
        F.sum("__got").alias("got"), F.sum("__want").alias("want"),
        *[f(F.when(F.col(f"__{s}") == 1, F.col(n))).alias(f"{f.__name__}_{s}_{n}") for n in names for s in ("got", "want") for f in (F.min, F.max)],
    ).withColumns({"wide": _any(_spread(n) > tolerance for n in names), "apart": _any(_gap(n) > tolerance for n in names)}).observe(
        seen, *[F.coalesce(F.sum(s), F.lit(0)).alias(f"{s}_rows") for s in ("got", "want")], _settled()
    ).filter("wide AND NOT apart AND got > 0 AND want > 0").select("key", (F.col("got") + F.col("want")).alias("rows"))
    groups.write.parquet(path)
    counted = spark.createDataFrame([tuple(seen.get[c] for c in TOTALS)], ", ".join(f"{c} long" for c in TOTALS))
    wanted = spark.read.schema(groups.schema).parquet(path)
    if wanted.isEmpty():
        return counted
    small = _of_groups(both, wanted.filter(F.col("rows") <= BEST_ROWS), ["key"])
    found = small.groupBy("key").applyInPandas(_small_group(names, tolerance), "matched long")
    larger = wanted.filter(F.col("rows") > BEST_ROWS)
    if not larger.isEmpty():
        rows = _of_groups(both, larger, ["key"]).groupBy("key", *names).agg(F.sum("__got").alias("__got"), F.sum("__want").alias("__want"))
        found = found.union(_matched_in_order(rows, names, tolerance))
    none = F.lit(0).cast("long")
    return counted.union(found.agg(none, none, F.coalesce(F.sum("matched"), F.lit(0)))).agg(*[F.sum(c).alias(c) for c in TOTALS])


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))


def _spread(name: str) -> Column:
    return F.greatest(f"max_got_{name}", f"max_want_{name}") - F.least(f"min_got_{name}", f"min_want_{name}")


def _gap(name: str) -> Column:
    """How far the nearest values of the two sides lie apart, negative where the sides overlap."""
    return F.greatest(F.col(f"min_want_{name}") - F.col(f"max_got_{name}"), F.col(f"min_got_{name}") - F.col(f"max_want_{name}"))


def _matched_in_order(rows: DataFrame, names: list[str], tolerance: float) -> DataFrame:
    """``matched`` of groups of any size, cut along the global order of each column."""
    cut, rows = ["key"], materialise(rows)
    for i, name in enumerate(names[:CUT_COLUMNS]):
        order = [F.col(c) for c in (name, *[n for n in names if n != name])]
        beside = with_previous(rows, order, [name], "previous", cut)
        # Within a group the values of a column are all null or none is.
        close = F.coalesce(F.col(name) - F.col(f"previous.{name}") <= tolerance, F.lit(True))
        fresh = F.when(F.col("previous").isNotNull() & close, 0).otherwise(1)
        rows = running_total(beside.withColumn("__fresh", fresh).drop("previous"), order, F.col("__fresh"), f"part{i}", cut).drop("__fresh")
        cut = [*cut, f"part{i}"]
    clusters = _clusters(rows, cut, names, tolerance)
    hard = _open_rows(rows, clusters, cut).na.fill(0.0, names)
    settled = clusters.agg(_settled())
    return settled.union(hard.groupBy(*cut).applyInPandas(_stretched(names, tolerance), "matched long"))


def _clusters(rows: DataFrame, cut: list[str], names: list[str], tolerance: float) -> DataFrame:
    """Rows of either side per cluster, and whether some of its values lie further apart than the tolerance."""
    wide = reduce(Column.__or__, [F.coalesce(F.max(n) - F.min(n) > tolerance, F.lit(False)) for n in names], F.lit(False))
    return rows.groupBy(*cut).agg(F.sum("__got").alias("got"), F.sum("__want").alias("want"), wide.alias("wide"))


def _settled() -> Column:
    """Matches of the clusters in which everything matches."""
    return F.coalesce(F.sum(F.when(~F.col("wide"), F.least("got", "want"))), F.lit(0)).alias("matched")


def _of_groups(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys, nulls included, are among the ``wanted`` ones."""
    named = wanted.select(*[F.col(c).alias(f"of_{c}") for c in keys])
    return rows.join(named, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys]), "left_semi")


def _open_rows(rows: DataFrame, clusters: DataFrame, cut: list[str]) -> DataFrame:
    """The rows of clusters that stretch and have both sides."""
    return _of_groups(rows, clusters.filter("wide AND got > 0 AND want > 0"), cut)


def row_match_score(got: DataFrame, want: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """got_rows, want_rows, matched and score, the matched share of the longer table's rows; 1 for two empty tables."""
    longer = F.greatest("got_rows", "want_rows")
    return matched_rows(got, want, tolerance).withColumn(
        "score", F.when(longer == 0, F.lit(1.0)).otherwise(F.col("matched") / longer)
    )
