"""Mentions of dictionary names, and neighbouring turns, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallywork.operators import mentions as mn
from tallywork.operators import textjobs
from tallywork.operators.globalorder import with_previous
from tests.conftest import rows


def plain(texts, names):
    out = {}
    for name in {(n or "").lower() for n in names} - {""}:
        edge = [r"(?<![A-Za-z0-9_])" if name[0] in mn.WORD else "", r"(?![A-Za-z0-9_])" if name[-1] in mn.WORD else ""]
        pattern = re.compile(edge[0] + re.escape(name) + edge[1])
        out[name] = sum(bool(pattern.search((t or "").lower())) for t in texts)
    return sorted(out.items())


@pytest.mark.parametrize("slice_bytes", [mn.SLICE_BYTES, 400])
def test_counts_are_those_of_patterns(spark, monkeypatch, slice_bytes):
    """Names that hold, begin and end each other; one slice and many."""
    monkeypatch.setattr(mn, "SLICE_BYTES", slice_bytes)
    random.seed(slice_bytes)
    parts = ["ab", "a", "b", "#", " ", "é", "A_", "9", "-", "."]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(200)] + [None, "", "a", "A b", "#a#"] + ["same a text"] * 5
    names = ["".join(random.choices(parts, k=random.randint(1, 4))) for _ in range(150)] + [None, "", "Ab", "aB", "same a text"]
    got = mn.mentions(
        spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), "t", spark.createDataFrame([(n,) for n in names], "n string"), "n"
    )
    want = plain(texts, names)
    assert sorted(map(tuple, got.collect())) == want and sum(n > 0 for _, n in want) > 20


def test_without_names_or_texts(spark):
    none, some = spark.createDataFrame([], "x string"), spark.createDataFrame([("a b",)], "x string")
    assert mn.mentions(some, "x", none, "x").count() == 0
    assert rows(mn.mentions(none, "x", some, "x")) == [("a b", 0)]


def test_previous_row_across_partitions(spark):
    """One group holds most rows and lies in every partition; others are small, one is null."""
    random.seed(1)
    data = [("hot", i, f"t{i}") for i in range(900)] + [(random.choice(["x", "y", None, f"z{i % 40}"]), i, f"u{i}") for i in range(300)]
    random.shuffle(data)
    df = spark.createDataFrame(data, "g string, n int, v string").repartition(6)
    got = {(r.g, r.n): r.previous and (r.previous.n, r.previous.v) for r in with_previous(df, [F.col("n")], ["n", "v"], partition_by=["g"]).collect()}
    want, last = {}, {}
    for g, n, v in sorted(data, key=lambda r: r[1]):
        want[g, n] = last.get(g)
        last[g] = (n, v)
    assert got == want
    assert with_previous(df.limit(0), [F.col("n")], ["n"], partition_by=["g"]).count() == 0


def test_dialogue_pairs(spark):
    turns = [
        (1, 0, "system", "be brief"), (1, 1, "user", " Count? "), (1, 2, "assistant", "```sql\nSELECT 1\n```"), (1, 3, "assistant", "more"),
        (1, 4, "user", None), (1, 5, "user", "Sum?"), (1, 7, "assistant", None), (2, 0, "assistant", "first"), (3, 9, "user", "alone"),
        (None, 0, "user", "q"), (None, 1, "assistant", "```\na\n``` b"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(5)
    out = textjobs.dialogue_pairs(df, "conv_id", "turn", "role", "text")
    assert rows(out) == sorted([(1, 2, "Count?", "SELECT 1"), (1, 7, "Sum?", ""), (None, 1, "q", "a")], key=repr)


def test_one_long_conversation(spark):
    """A conversation with most of the turns spreads over partitions and keeps every pair."""
    turns = spark.range(6000).select(
        F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"),
    )
    out = textjobs.dialogue_pairs(turns, "conv_id", "turn", "role", "text")
    assert rows(out.filter("conv_id = 7"), "turn", "nl", "sql") == sorted([(i, f"t{i - 1}", f"t{i}") for i in range(1, 4000, 2)], key=repr)
    assert out.filter("conv_id != 7").count() == 0
