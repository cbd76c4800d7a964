"""Exact dedup as a tree-merge of sorted digest runs.

Each input partition is a run: its rows reduced to one entry per digest. In every round the
runs whose numbers agree but for the last ``log2(fan_in)`` bits form one new run (a binomial
tree with a multiway merge at its nodes). An entry keeps the best row of its digest. The key
of a run is a 64-bit hash; entries merge only if the SHA-256 of the whole normalised text
agrees too, so a clash of the short key never joins different texts.

A run is spread over all tasks by its digest, so no run, the last one included, is ever in one
task. A digest has at most ``fan_in`` entries per merge, so a text with a third of all rows is
no hot key. Answers go back down: one entry per run and digest meets the merged result, then
the rows meet their own run's entry, of which no key is larger than one input partition.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import boxed, named, store, text_of, unboxed, without_spaces

FAN_IN = 8
DIGEST = ("short", "sha")


def _digests(text) -> dict:
    bare = without_spaces(text)
    return {"short": F.xxhash64(bare), "sha": F.unhex(F.sha2(bare, 256)), "n_chars": F.length(text)}


def _merge(entries: DataFrame, run) -> DataFrame:
    return (
        entries.groupBy(run.alias("run"), *DIGEST)
        .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal if they are the same without white space; a null text is empty. Of equal texts
    the longest original stays, then the smallest id (a null id comes last), and of rows that tie
    even so exactly one. An empty table gives an empty result; other columns are not read.
    """
    rows = store(
        docs.select(named(id_col).alias("doc_id"), text_of(text_col).alias("text")).select(
            "doc_id", *[c.alias(n) for n, c in _digests(F.col("text")).items()],
            F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("place"),
        ),
        "digests",
    )
    runs = 1 + (rows.agg(F.max("run")).first()[0] or 0)
    best = F.struct(
        (-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "place"
    )
    leaves = _merge(rows.select("run", *DIGEST, best.alias("best"), F.lit(1).cast("long").alias("n")), F.col("run"))
    merged, bits = leaves, int(math.log2(fan_in))
    while runs > 1:
        merged = _merge(merged, F.shiftright("run", bits))
        runs = math.ceil(runs / fan_in)
    answers = leaves.select("run", *DIGEST).join(merged.drop("run"), list(DIGEST))
    return rows.join(answers, ["run", *DIGEST]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("best.place")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_chars",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps."""
    decided = exact_dedup(docs, id_col, text_col, fan_in).filter("kept")
    keys = ("id", "no_id", "sha", "n_chars")
    keep = decided.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("doc_id").isNull().alias("no_id"),
        F.unhex("text_sha256").alias("sha"), "n_chars",
    )
    found = _digests(text_of(text_col))
    box = boxed(
        docs, id=F.coalesce(named(id_col).cast("string"), F.lit("")), no_id=named(id_col).isNull(),
        sha=found["sha"], n_chars=found["n_chars"],
    )
    # Rows that repeat id and text are all alike to the decision; one of them stays.
    return unboxed(box.join(keep, list(keys), "left_semi").dropDuplicates(list(keys)))
