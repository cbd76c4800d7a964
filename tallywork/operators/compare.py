"""Order-insensitive comparison of two result tables with a numeric tolerance.

Both sides are sorted by the same columns (their sorted names) and compared position by
position. The two tables become one table of distinct rows with their numbers of copies
on either side, so copies cost nothing to sort and one global order serves both. Rows
that fill the same positions on both sides match as they are; only the others unfold to
positions. They are laid out by blocks of positions: a block holds a bounded number of
cells whatever the distribution of values, and one exchange brings its two sides together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.operators.globalorder import running_totals

TOLERANCE = 0.001
PASS_SHARE = 0.95
BLOCK_ROWS = 65536

# The messages of an outcome.
BOTH_EMPTY = "Both queries return empty result"
ONE_EMPTY = "One query returns empty, other doesn't"
ROW_COUNTS = "Row count mismatch: %d vs %d"
COLUMNS_DIFFER = "Column mismatch: {} vs {}"
SCORE = "Match score: %.3f"

FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)


def _plain(side: DataFrame) -> DataFrame:
    """The columns in the order of their names, renamed: names may hold dots or repeat. Maps become sorted entries.

    The new names sort as the columns stand.
    """
    order = sorted(range(len(side.columns)), key=lambda i: side.columns[i])
    names = [f"c{n:05d}" for n in range(len(order))]
    renamed = side.toDF(*[names[order.index(i)] for i in range(len(order))])
    return renamed.select(*[
        F.array_sort(F.map_entries(c)).alias(c) if isinstance(renamed.schema[c].dataType, T.MapType) else c for c in names
    ])


def _same_names(got: DataFrame, want: DataFrame) -> bool:
    return sorted(got.columns) == sorted(want.columns)


def _family(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return data_type.simpleString()


def _comparable(got: DataFrame, want: DataFrame, column: str) -> bool:
    return _family(got.schema[column].dataType) == _family(want.schema[column].dataType)


def _runs(got: DataFrame, want: DataFrame) -> DataFrame:
    """Distinct rows with the half-open range of positions their copies fill on each side."""
    columns = sorted(got.columns)
    sides = [
        side.select(
            *[F.col(c) if _comparable(got, want, c) else F.col(c).cast("string").alias(c) for c in columns],
            F.lit(in_got).alias("__got"), F.lit(1 - in_got).alias("__want"),
        )
        for side, in_got in ((got, 1), (want, 0))
    ]
    counted = sides[0].unionByName(sides[1]).groupBy(*columns).agg(
        F.sum("__got").alias("__got"), F.sum("__want").alias("__want")
    )
    order = [F.col(c).asc_nulls_last() for c in columns]
    ends = {"__got_end": F.col("__got"), "__want_end": F.col("__want")}
    return running_totals(counted, order, ends).select(
        F.struct(*columns).alias("row"), "__got", "__want",
        (F.col("__got_end") - F.col("__got")).alias("__got_start"),
        (F.col("__want_end") - F.col("__want")).alias("__want_start"),
    )


def _same(left: Column, right: Column, left_type: T.DataType, right_type: T.DataType, tolerance: float) -> Column:
    """NULL (or NaN) equals NULL; two fractional numbers may differ by ``tolerance``."""
    if isinstance(left_type, FRACTIONAL) and isinstance(right_type, FRACTIONAL):
        a, b = (F.nullif(c.cast("double"), F.lit(float("nan"))) for c in (left, right))
        close = F.abs(a - b) <= tolerance
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close | (a == b))
    if _family(left_type) != _family(right_type):
        return left.isNull() & right.isNull()
    return left.eqNullSafe(right)


def cell_matches(got: DataFrame, want: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row: ``got_rows, want_rows, matching`` cells, for tables of the same columns."""
    got, want = _plain(got), _plain(want)
    columns = got.columns
    if not columns:
        return got.sparkSession.createDataFrame([(0, 0, 0)], "got_rows long, want_rows long, matching long")
    runs = _runs(got, want)
    aligned = (
        F.lit(all(_comparable(got, want, c) for c in columns))
        & (F.col("__got_start") == F.col("__want_start")) & (F.col("__got") == F.col("__want"))
    )
    size = F.lit(BLOCK_ROWS)
    both_sides = F.array(*[
        F.struct(
            F.lit(side).alias("side"), F.col(f"__{side}_start").alias("start"),
            (F.col(f"__{side}_start") + F.col(f"__{side}")).alias("end"),
        )
        for side in ("got", "want")
    ])
    # A run that fills the same positions on both sides goes along as one row of its first position, with its copies alone.
    alike = F.struct(F.lit(None).cast("string").alias("side"), F.col("__got_start").alias("start"), (F.col("__got_start") + 1).alias("end"))
    runs = runs.select(
        F.when(~aligned, F.col("row")).alias("row"), F.when(aligned, F.col("__got")).alias("whole"),
        F.when(aligned, F.array(alike)).otherwise(both_sides).alias("s"),
    )
    spread = runs.select("row", "whole", F.explode("s").alias("s")).filter("s.end > s.start")
    blocks = F.sequence(F.floor(F.col("s.start") / size), F.floor((F.col("s.end") - 1) / size))
    laid = spread.withColumn("__block", F.explode(blocks)).repartition("__block")
    first = F.greatest(F.col("s.start"), F.col("__block") * size)
    last = F.least(F.col("s.end"), (F.col("__block") + 1) * size) - 1
    pairs = (
        laid.select(
            "__block", F.explode(F.sequence(first, last)).alias("__position"), "whole",
            *[F.when(F.col("s.side") == side, F.col("row")).alias(side) for side in ("got", "want")],
        )
        .groupBy("__block", "__position")
        .agg(
            F.sum("whole").alias("whole"),
            F.first("got", ignorenulls=True).alias("got"), F.first("want", ignorenulls=True).alias("want"),
        )
    )
    matches = [
        _same(
            F.col("got").getField(c), F.col("want").getField(c),
            got.schema[c].dataType, want.schema[c].dataType, tolerance,
        ).cast("long")
        for c in columns
    ]
    both = F.col("got").isNotNull() & F.col("want").isNotNull()
    copies = F.coalesce("whole", F.lit(0))
    return pairs.agg(
        F.sum(copies + F.col("got").isNotNull().cast("int")).alias("got_rows"),
        F.sum(copies + F.col("want").isNotNull().cast("int")).alias("want_rows"),
        F.sum(copies * len(columns) + F.when(both, sum(matches[1:], matches[0])).otherwise(0)).alias("matching"),
    ).select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("got_rows", "want_rows", "matching")])


def cell_match_score(got: DataFrame, want: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Share of equal cells; 0 where the shapes differ or there are no cells."""
    if not _same_names(got, want):
        return got.sparkSession.createDataFrame([(0.0,)], "score double")
    width = F.lit(len(got.columns))
    cells = F.nullif(F.col("got_rows") * width, F.lit(0)).cast("double")
    score = F.when(F.col("got_rows") == F.col("want_rows"), F.col("matching") / cells)
    return cell_matches(got, want, tolerance).select(F.coalesce(score, F.lit(0.0)).alias("score"))


def compare_results(
    got: DataFrame, want: DataFrame, tolerance: float = TOLERANCE, pass_share: float = PASS_SHARE
) -> DataFrame:
    """One row ``passed, score, message``.

    1.0 both empty; 0.0 one empty; 0.5 other column names; 0.6 other row count; else the
    share of equal cells.
    """
    if _same_names(got, want):
        counted = cell_matches(got, want, tolerance)
        cells = F.nullif(F.col("got_rows") * len(got.columns), F.lit(0)).cast("double")
        share = F.col("matching") / cells
        rest = (
            F.when(
                F.col("got_rows") != F.col("want_rows"),
                F.struct(
                    F.lit(0.6).alias("score"),
                    F.format_string(ROW_COUNTS, "got_rows", "want_rows").alias("message"),
                ),
            )
            .otherwise(F.struct(share.alias("score"), F.format_string(SCORE, share).alias("message")))
        )
    else:
        sides = [
            side.limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("side"), "n")
            for side, label in ((got, "got"), (want, "want"))
        ]
        counted = sides[0].unionByName(sides[1]).agg(
            F.sum(F.when(F.col("side") == "got", F.col("n"))).alias("got_rows"),
            F.sum(F.when(F.col("side") == "want", F.col("n"))).alias("want_rows"),
        )
        rest = F.struct(
            F.lit(0.5).alias("score"),
            F.lit(COLUMNS_DIFFER.format(sorted(got.columns), sorted(want.columns))).alias("message"),
        )
    no_got, no_want = F.col("got_rows") == 0, F.col("want_rows") == 0
    outcome = (
        F.when(no_got & no_want, F.struct(
            F.lit(1.0).alias("score"), F.lit(BOTH_EMPTY).alias("message")))
        .when(no_got | no_want, F.struct(
            F.lit(0.0).alias("score"), F.lit(ONE_EMPTY).alias("message")))
        .otherwise(rest)
    )
    differing = F.lit(not _same_names(got, want)) & ~(no_got & no_want)
    return counted.select(outcome.alias("r"), differing.alias("d")).select(
        ((F.col("r.score") >= pass_share) & ~F.col("d")).alias("passed"), "r.score", "r.message"
    )
