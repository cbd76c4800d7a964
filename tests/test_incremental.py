"""Marts built batch by batch against marts built at once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallywork.operators.orderfacts import order_facts
from tallywork.plans import incremental as inc
from tallywork.plans import marts
from tests.conftest import rows

MEASURES = ("quantity", "revenue", "gross_profit", "profit_margin")
WHOLE = {"fct_revenue_daily": marts.fct_revenue_daily, "fct_kpis_monthly": marts.fct_kpis_monthly}


def files(folder):
    """Data files below a folder with the time they were written."""
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")
    }


@pytest.mark.parametrize("mart", [inc.DAILY, inc.MONTHLY], ids=lambda m: m.name)
def test_batches_make_the_whole(spark, star, tmp_path, mart):
    """Three batches of any orders, months overlapping, one of them run twice; then merged states."""
    facts = order_facts(star, mart.keys, MEASURES)
    want = rows(WHOLE[mart.name](facts))
    folder = str(tmp_path)
    for batch in (0, 1, 2, 1):
        inc.add_batch(folder, mart, facts.filter(F.pmod(F.xxhash64("order_id"), F.lit(3)) == batch), f"b{batch}")
    out = inc.read_mart(spark, folder, mart)
    assert rows(out, *WHOLE[mart.name](facts).columns) == want
    months = [r[0] for r in spark.read.parquet(f"{folder}/{mart.name}_states").select(inc.MONTH).distinct().collect()]
    inc.compact(spark, folder, mart, months[:5], "merged")
    assert inc.add_batch(folder, mart, facts.limit(0), "none") == []
    states = inc._states_of(spark, folder, mart, months)
    assert rows(inc.mart_of(states, mart).drop(inc.MONTH), *out.columns) == want
    assert states.filter(F.col(inc.MONTH).isin(months[:5])).select("batch").distinct().count() == 1


def facts_of(spark, data):
    """(order, date, region, customer, cents) as order facts at the monthly keys."""
    return spark.createDataFrame(data, "order_id long, d string, region string, customer_id long, cents long").select(
        "order_id", F.to_date("d").alias("order_month"), "region", "customer_id", F.lit(0).cast("long").alias("revenue_hi"),
        F.col("cents").alias("revenue_lo"), F.lit(0).cast("long").alias("gross_profit_hi"), F.col("cents").alias("gross_profit_lo"),
        F.lit(1).cast("long").alias("revenue_rows"), F.lit(0.5).alias("margin_sum"), F.lit(1).cast("long").alias("margin_rows"),
    )


def test_late_orders_touch_their_month_only(spark, tmp_path):
    random.seed(9)
    folder = str(tmp_path)
    months = ["2024-01-01", "2024-02-01", "2024-03-01", None]
    first = [(i, random.choice(months), random.choice(["N", None]), random.choice([None, 7, 8, 40000, -3]), 100) for i in range(80)]
    assert inc.add_batch(folder, inc.MONTHLY, facts_of(spark, first), "a") == [0, 202401, 202402, 202403]
    before = files(folder)
    late = [(900, "2024-02-01", "N", 7, 50), (901, "2024-02-01", "N", 99, 50)]
    assert inc.add_batch(folder, inc.MONTHLY, facts_of(spark, late), "b") == [202402]
    after = files(folder)
    old_states = {f for f in before if "_states" in f}
    assert old_states <= set(after) and all("part=202402" in f for f in set(after) - set(before))
    assert all("part=202402" in f for f in before if before[f] != after.get(f))
    got = {(r.order_month and str(r.order_month), r.region): (r.order_count, r.customer_count, r.revenue) for r in inc.read_mart(spark, folder, inc.MONTHLY).collect()}
    want = {}
    for _, month, region, who, cents in first + late:
        n, members, total = want.get((month, region), (0, set(), 0))
        want[month, region] = (n + 1, members | ({who} - {None}), total + cents)
    assert got == {k: (n, len(m), t / 100) for k, (n, m, t) in want.items()}


def test_states_of_a_month_make_a_file_per_slot(spark, tmp_path, monkeypatch):
    """However many tasks write, and with months and members spread over slots the mart is the same."""
    random.seed(4)
    months = ["2024-01-01", "2024-02-01", None]
    data = [(i, random.choice(months), random.choice(["N", None]), random.choice([None, 7, 8, 9]), 100) for i in range(200)]
    facts = facts_of(spark, data).withColumn("order_date", F.col("order_month")).withColumns(
        {"customer_segment": F.lit("s"), "product_category": F.lit("c"), "quantity": F.lit(2).cast("long")}
    ).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = []
        for size, slots in ((1000, 1), (100, 2)):
            monkeypatch.setattr(inc, "FACTS_PER_SLOT", size, raising=False)
            folder = str(tmp_path / str(size))
            for batch in (0, 1):
                args = (100,) if slots > 1 else ()
                inc.add_batch(folder, inc.DAILY, facts.filter(F.col("order_id") % 2 == batch), f"b{batch}", *args)
                made = [os.path.dirname(f) for f in files(f"{folder}/fct_revenue_daily_states") if f"b{batch}" in f]
                assert len(made) <= 3 * slots and len(set(made)) == 3
            got.append(rows(inc.read_mart(spark, folder, inc.DAILY)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[0] == got[1] == rows(marts.fct_revenue_daily(facts), *inc.read_mart(spark, folder, inc.DAILY).columns)
