"""Mixing sources to target weights by prefix sums in a random order.

Every document gets a hash-random key. Documents are range-sorted by source and key, so that even
a source with a third of all rows spreads over many partitions, and sizes are summed along that
order: partition totals first, then a carry of at most one row per partition. The budget of a source
is its target in whole words: as many whole epochs as fit, then the documents in key order up to
the exact cut, where the last one gives only the words that are left.

Targets fill up like water: a source takes its share by weight but not above ``MAX_EPOCHS`` times its
size, and what is above goes to the others by weight. With sources in the order of cap / weight, the
first k that are full leave the level (total - their caps) / (weights of the others); the first level
that fills no further source is the right one. That table has one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import ROW, boxed, named, row_keys, store, text_of, unboxed
from tallywork.session import materialise

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Between a word and the white space after it.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size); sources by code point, null last, take the weights in turn."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = by_source.select("source", "source_size", weight.alias("weight"), (max_epochs * F.col("source_size")).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.select(
        "*", ((F.sum("source_size").over(Window.partitionBy()) - full) / others).alias("level"),
        F.row_number().over(order).alias("nth"),
    )
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("nth"))).over(Window.partitionBy())
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def prefix_sums(rows: DataFrame, order_by: Sequence[str], value: str, out: str, group: str) -> DataFrame:
    """``rows`` plus, in ``out``, the sum of ``value`` over its group up to and with itself, in the order of ``order_by``.

    The rows are range-sorted by group and order, so a group spreads over partitions. Each partition sums its part of a
    group; the sums of the partitions before, at most one row per partition, are added as a carry. Both steps must see
    the same partitions, hence the checkpoint.
    """
    sorted_rows = materialise(rows.repartitionByRange(group, *order_by).withColumn("part", F.spark_partition_id()))
    totals = sorted_rows.groupBy(group, "part").agg(F.sum(value).alias("total"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(F.col(group).alias("of_group"), F.col("part").alias("of_part"), F.sum("total").over(earlier).alias("carry"))
    here = Window.partitionBy("part", group).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sorted_rows.withColumn(out, F.sum(value).over(here))
    # Only groups that go on from one partition to the next have a carry: fewer than there are partitions.
    carried = summed.join(
        F.broadcast(carries.filter("carry is not null")), (F.col("part") == F.col("of_part")) & F.col(group).eqNullSafe(F.col("of_group")), "left"
    )
    return carried.select(*rows.columns, (F.col(out) + F.coalesce("carry", F.lit(0))).alias(out))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, no_id, text_hash.

    ``size`` counts words (null text: none), ``taken`` the words that the mix takes, repeats counted. A
    null source is a source; documents without words are never taken. The order, and so the result, depends on the ids
    and ``seed`` alone; rows that repeat an id, or have none, come in the order of their texts' hashes.
    """
    rows = store(
        docs.select(
            *[c.alias(n) for n, c in row_keys(id_col, text_col).items() if n != "id"],
            named(id_col).alias("doc_id"), named(source_col).alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), named(id_col).cast("string"), F.when(named(id_col).isNull(), F.xxhash64(text_of(text_col))))).alias("key"),
        ),
        "sizes",
    )
    goals = store(targets(rows, weights, max_epochs), "targets")
    summed = prefix_sums(rows, ["key", "doc_id", "text_hash", "size"], "size", "upto", "source")
    budget = F.round("target").cast("long")
    epochs = F.coalesce(F.floor(F.try_divide(budget.cast("decimal(38,0)"), F.col("source_size"))).cast("long"), F.lit(0))
    left = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.col("upto") - F.col("size"))))
    goals = goals.select(F.col("source").alias("of"), "source_size", "target", budget.alias("budget"), epochs.alias("epochs"))
    return summed.join(goals, summed["source"].eqNullSafe(goals["of"])).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * F.col("epochs") + part).alias("taken"), "no_id", "text_hash",
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, once per epoch; the text at a source's cut ends at its last word taken.

    Rows that repeat id and text are taken as one row with the words of all of them.
    """
    keys = ["id", "no_id", "text_hash"]
    taken = (
        mix(docs, id_col, text_col, **options)
        .select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "no_id", "text_hash", "size", "taken")
        .groupBy(*keys).agg(F.max("size").alias("size"), F.sum("taken").alias("taken")).filter("taken > 0")
    )
    found = boxed(docs, **row_keys(id_col, text_col)).dropDuplicates(keys).join(taken, keys)
    copies = found.select(
        ROW, "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")))).alias("copy")
    )
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    text = F.col(ROW)[text_col]
    cut = F.when(words == F.col("size"), text).otherwise(
        F.array_join(F.slice(F.split(text, WORD_END), F.lit(1), words.cast("int")), "")
    )
    return unboxed(copies.select(F.col(ROW).withField("`" + text_col + "`", cut).alias(ROW)))
