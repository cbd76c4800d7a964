"""Pareto frontier of a table of score vectors, exact at any size.

Equal vectors collapse first, and every partition drops rows dominated within itself. What is left is laid on a grid whose
lines are quantiles of each score, about as fine as the rows need. The cells that hold rows are a small table: a bitmap on
the driver. A cell above another in every score dominates all of its rows, so that cell is dropped unread; two cells of
which neither is at least the other in every score hold no comparable rows and never meet. The rows of a remaining cell
are held against its own and those of the cells that reach it everywhere, which then lie level with it in some score.
Cells are compared in blocks, so that no task sees more than two of them; only dominated vectors are returned.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.session import materialise, ship_package

BLOCK_ROWS = 8192
WINDOW_ROWS = 256
SLICE = 1024
#: The grid aims at so many rows per cell on the frontier, with bounds on its cells and on the pairs of cells that meet.
CELL_ROWS = 512
MAX_CELLS = 1 << 16
MAX_MEETINGS = 1_000_000


def dominated_by(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each of ``rows``: does some one of ``others`` reach it everywhere and beat it somewhere?"""
    hit = np.zeros(len(rows), dtype=bool)
    for start in range(0, len(others), SLICE):
        open_rows = np.flatnonzero(~hit)
        if not len(open_rows):
            break
        a, b = rows[open_rows, None, :], others[None, start:start + SLICE, :]
        hit[open_rows] = ((b >= a).all(axis=2) & (b > a).any(axis=2)).any(axis=1)
    return hit


def frontier_of(rows: np.ndarray) -> np.ndarray:
    """Mask of the non-dominated rows; ``rows`` come best sum first."""
    keep = np.zeros(len(rows), dtype=bool)
    for start in range(0, len(rows), SLICE):
        block = rows[start:start + SLICE]
        alive = ~dominated_by(block, rows[keep])
        alive[alive] = ~dominated_by(block[alive], block[alive])
        keep[start:start + SLICE] = alive
    return keep


def _drop_local(objectives: list[str]):
    """Per partition: drop rows dominated by a sliding window of the best rows seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = np.empty((0, len(objectives)))
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                part = batch.iloc[start:start + SLICE]
                part = part.iloc[np.argsort(-part[objectives].sum(axis=1).to_numpy(), kind="stable")]
                part = part[~dominated_by(part[objectives].to_numpy(float), window)]
                part = part[frontier_of(part[objectives].to_numpy(float))]
                window = np.concatenate([window, part[objectives].to_numpy(float)])
                best = np.argsort(-window.sum(axis=1), kind="stable")[:WINDOW_ROWS]
                window = window[best]
                yield part

    return run


def _frontier_at_once(objectives: list[str]):
    """The frontier of all rows of one task, a block of them at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            rows = pd.concat(parts)
            rows = rows.iloc[np.argsort(-rows[objectives].sum(axis=1).to_numpy(), kind="stable")]
            yield rows[frontier_of(rows[objectives].to_numpy(float))]

    return run


def _dominated_own(objectives: list[str]):
    """Of one pair of blocks: the rows of the first that some row of the second dominates."""

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        own, others = pair[pair["__own"]][objectives], pair[~pair["__own"]][objectives]
        return own[dominated_by(own.to_numpy(float), others.to_numpy(float))]

    return run


@dataclass(frozen=True)
class GridPlan:
    """What meets on a grid: the cells that stay, and for each those whose rows it is held against (itself included)."""

    counts: Mapping[int, int]
    against: Mapping[int, Sequence[int]]

    def faced(self, cell: int) -> int:
        return sum(self.counts[c] for c in self.against[cell])

    @property
    def compared(self) -> int:
        """Pairs of rows that are compared, each way counted."""
        return sum(self.counts[c] * self.faced(c) for c in self.against)

    @property
    def meetings(self) -> int:
        return sum(map(len, self.against.values()))


def plan_grid(counts: Mapping[int, int], shape: Sequence[int]) -> GridPlan:
    """The plan for cells (flat numbers in ``shape``, more is better on each axis) with so many rows each."""
    held = np.zeros(shape, bool)
    held.flat[list(counts)] = True
    reached = held
    for axis in range(len(shape)):
        reached = np.flip(np.logical_or.accumulate(np.flip(reached, axis), axis), axis)
    above = np.zeros(shape, bool)
    above[tuple(slice(0, -1) for _ in shape)] = reached[tuple(slice(1, None) for _ in shape)]
    at = np.argwhere(held & ~above)
    numbers = np.ravel_multi_index(at.T, shape) if len(at) else np.zeros(0, int)
    against = {int(n): numbers[(at >= cell).all(axis=1)].tolist() for n, cell in zip(numbers, at)}
    return GridPlan(dict(counts), against)


def grid_lines(rows: int, dims: int) -> int:
    """Cells per axis: the frontier crosses about as many cells as there are rows for."""
    wanted = max(2, round((rows / CELL_ROWS) ** (1 / max(1, dims - 1))))
    return max(2, min(wanted, int(MAX_CELLS ** (1 / dims))))


def _gridded(vectors: DataFrame, names: list[str], lines: int) -> tuple[DataFrame, list[int]]:
    """``vectors`` with the flat number of their cell, and the grid's shape."""
    cuts = vectors.approxQuantile(names, [k / lines for k in range(1, lines)], 1 / (4 * lines))
    cuts = [sorted(set(c)) for c in cuts]
    shape = [len(c) + 1 for c in cuts]
    cell = F.lit(0)
    for name, own, size in zip(names, cuts, shape):
        limits = F.array(*map(F.lit, own)).cast("array<double>")
        cell = cell * size + F.size(F.filter(limits, F.col(name).__ge__))
    return vectors.withColumn("__cell", cell), shape


def grid_plan(vectors: DataFrame, names: list[str]) -> tuple[DataFrame, GridPlan]:
    """The rows on their grid and the plan for it; coarser if too many cells would meet."""
    lines = grid_lines(vectors.count(), len(names))
    while True:
        gridded, shape = _gridded(vectors, names, lines)
        counts = {r["__cell"]: r["count"] for r in gridded.groupBy("__cell").count().collect()}
        plan = plan_grid(counts, shape)
        if plan.meetings <= MAX_MEETINGS or lines <= 2:
            return gridded, plan
        lines = max(2, lines // 2)


def _survivors(gridded: DataFrame, plan: GridPlan, names: list[str], block_rows: int) -> DataFrame:
    """The rows that no other dominates, of the cells that stay."""
    blocks = {c: (-(-plan.counts[c] // block_rows), -(-plan.faced(c) // block_rows)) for c in plan.against}
    spark = gridded.sparkSession
    meetings = spark.createDataFrame(
        [(other, cell, *blocks[cell]) for cell, others in plan.against.items() for other in others],
        "__cell int, __target int, __is int, __js int",
    )
    row = F.xxhash64(*names)
    # At most MAX_MEETINGS rows of four numbers.
    met = gridded.join(F.broadcast(meetings), "__cell")
    others = met.select(
        *names, "__target", F.explode(F.sequence(F.lit(0), F.col("__is") - 1)).alias("__i"),
        F.pmod(row, F.col("__js")).cast("int").alias("__j"), F.lit(False).alias("__own"),
    )
    own = met.filter("__cell = __target").select(
        *names, "__target", F.pmod(row, F.col("__is")).cast("int").alias("__i"),
        F.explode(F.sequence(F.lit(0), F.col("__js") - 1)).alias("__j"), F.lit(True).alias("__own"),
    )
    schema = ", ".join(f"`{c}` double" for c in names)
    pairs = own.unionByName(others).groupBy("__target", "__i", "__j")
    dominated = pairs.applyInPandas(_dominated_own(names), schema).distinct()
    kept = gridded.join(F.broadcast(meetings.select("__cell").distinct()), "__cell", "left_semi")
    return kept.join(dominated, names, "left_anti").select(*names)


def pareto_frontier(df: DataFrame, objectives: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``df`` that no other row dominates (larger is better, NULL counts as 0).

    Rows with equal vectors all stay, and so does a row with a NaN, which is comparable to none. ``df`` is stored, for it
    is read for its vectors and again for its rows.
    """
    names = list(objectives)
    ship_package(df.sparkSession)
    df = materialise(df)
    scores = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names}
    vectors = df.select(*[s.alias(c) for c, s in scores.items()])
    odd = reduce(Column.__or__, [F.isnan(c) for c in names])
    distinct = vectors.filter(~odd).distinct()
    local = materialise(distinct.mapInPandas(_drop_local(names), distinct.schema))
    if local.limit(block_rows + 1).count() <= block_rows:
        frontier = local.coalesce(1).mapInPandas(_frontier_at_once(names), local.schema)
    else:
        frontier = _survivors(*grid_plan(local, names), names, block_rows)
    frontier = frontier.select(*[F.col(c).alias(f"__f_{c}") for c in names])
    matching = reduce(Column.__and__, [scores[c] == F.col(f"__f_{c}") for c in names])
    return df.join(frontier, matching, "left_semi").unionByName(df.filter(reduce(Column.__or__, [F.isnan(s) for s in scores.values()])))


def pareto_archive(
    archive: DataFrame, generation: DataFrame, objectives: Sequence[str], key: str, archive_size: int = 10
) -> DataFrame:
    """``archive`` with a generation inserted: the frontier of both, the best ``2 * archive_size`` by weighted score.

    Kept as a stored frontier, the archive stands for all earlier generations: what they hold beside is dominated by its
    rows, so only it and the new generation are read.
    """
    return best_of(insert_generation(archive, generation, objectives), key, archive_size)


def insert_generation(archive: DataFrame, generation: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """The stored frontier ``archive`` after a generation: rows of both that none dominates, stored."""
    return materialise(pareto_frontier(archive.unionByName(generation), objectives))


def best_of(front: DataFrame, key: str, archive_size: int = 10) -> DataFrame:
    return front.orderBy(F.col("weighted_score").desc_nulls_last(), key).limit(2 * archive_size)
