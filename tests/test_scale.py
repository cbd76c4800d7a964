"""What keeps the larger jobs in bounds: rows that stay where they are, tasks of bounded size, steps that run once."""

import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywork.operators import compare, lattice
from tallywork.operators import rulemining as rm
from tallywork.plans import benchmark, mart_queries, warehouse
from tallywork.sources import io


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_sink_without_moving_rows(spark, tmp_path):
    df = spark.range(0, 60, 1, 3).select("id", (F.col("id") % 2).alias("odd"))
    before = spark.conf.get(io.WRITERS)
    io.sink_parquet(df, str(tmp_path / "t"), ["odd"], even=False)
    assert len(list(tmp_path.glob("t/odd=*/*.parquet"))) == 3 * 2 and spark.conf.get(io.WRITERS) == before
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(i, i % 2) for i in range(60)]


def test_build_writes_the_facts_where_they_are(spark, monkeypatch):
    calls = {}
    monkeypatch.setattr(warehouse.io, "sink_parquet", lambda df, path, by=(), even=True: calls.update({path.rsplit("/", 1)[-1]: (list(by), even)}))
    empty = spark.createDataFrame([], "customer_id long, signup_date date")
    fact = spark.createDataFrame([], ", ".join(f"{c} long" for c in warehouse.marts.FACT_COLUMNS))
    monkeypatch.setattr(warehouse, "Observation", lambda: type("Seen", (), {"get": {"rows": 0}})())
    monkeypatch.setattr(type(fact), "observe", lambda self, *_: self)
    warehouse.build_marts(fact, empty, empty, None, "/nowhere")
    assert calls["fact_orders"] == (["year"], False)


def test_product_sums_in_tasks_of_bounded_size(star, monkeypatch, capsys):
    lines = star.table("lineitem").count()
    monkeypatch.setattr(mart_queries, "LINES_PER_TASK", 500)
    plan = plan_of(mart_queries.fct_product_performance(star), capsys)
    assert re.search(rf"hashpartitioning\(order_id#\w+, {-(-lines // 500)}\)", plan)


def test_lines_of_a_category_move_once(star, capsys):
    assert not re.search(r"hashpartitioning\(order_id#\w+, product_id", plan_of(benchmark.avg_value_by_category(star), capsys))


def test_comparison_orders_its_rows_once(spark, capsys):
    """Aligned runs and the others in one pass, with copies of both."""
    rows = [(1, 0.5)] * 3 + [(2, 0.5)] * 2 + [(4, 1.0)]
    got, want = (spark.createDataFrame(r, "k int, v double") for r in (rows + [(5, 1.0)], rows + [(6, 1.0)]))
    counted = compare.cell_matches(got, want)
    assert counted.first() == (7, 7, 13) and "Union" not in plan_of(counted, capsys)


def test_sizes_of_levels_hash_each_key_once(spark, monkeypatch):
    """Keys of equal values, and a member that equals a key, count like any others."""
    df = spark.range(2000).selectExpr("id % 40 AS a", "id % 40 AS b", "id % 40 AS who")
    monkeypatch.setattr(lattice.F, "struct", None)
    members, _ = lattice._sizes(df, ["a", "b"], "who")
    assert all(members[keys] == pytest.approx(40, rel=0.1) for keys in lattice.subsets(["a", "b"]))


def test_words_of_a_part_are_held_once():
    texts, each = 4000, 100
    words = [f"word{k}" for k in range(1000)]
    batch = pa.record_batch({
        "id": pa.array(range(texts)), "passed": pa.array([k % 2 == 0 for k in range(texts)]),
        "words": pa.array([[words[(k * 7 + n) % 1000] for n in range(each)] for k in range(texts)], pa.list_(pa.string())),
    })
    tracemalloc.start()
    (part,) = rm._parts(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(at) for at in part.at) == texts * each and peak < 60 * texts * each
