"""Scans, sinks, loading and the configured reports over the star schema.

The sink queries write a whole table to the shared folder and return what a scan reads back.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions.numbers import rounded
from tallywork.operators import configured
from tallywork.plans import marts
from tallywork.plans.registry import query
from tallywork.plans.warehouse import build_marts as build
from tallywork.plans.warehouse import extract_all as extract
from tallywork.schema import STAR
from tallywork.session import new_folder, still_there
from tallywork.sources import io
from tallywork.sources.querylog import query_log
from tallywork.sources.star import Star


@query()
def scan_parquet(star: Star) -> DataFrame:
    return io.scan_parquet(star.spark, f"{star.path}/orders.parquet", schema=STAR.schema("orders"))


@query()
def scan_csv(star: Star) -> DataFrame:
    path = new_folder(star.spark, "part-csv")
    io.sink_csv(star.table("part"), path)
    return io.scan_csv(star.spark, path, schema=STAR.schema("part"))


@query()
def sink_csv(star: Star) -> DataFrame:
    """Texts with line breaks and quotes survive."""
    path = new_folder(star.spark, "conversations-csv")
    io.sink_csv(star.table("conversations"), path)
    return io.scan_csv(star.spark, path, schema=STAR.schema("conversations"), multi_line=True)


@query()
def sink_parquet(star: Star) -> DataFrame:
    path = new_folder(star.spark, "customer-parquet")
    io.sink_parquet(star.table("customer"), path, ["c_mktsegment"])
    return io.scan_parquet(star.spark, path)


@query()
def scan_json(star: Star) -> DataFrame:
    path = new_folder(star.spark, "supplier-json")
    io.sink_json(star.table("supplier"), path)
    return io.scan_json(star.spark, path, schema=STAR.schema("supplier"))


@query()
def scan_tasks_jsonl(star: Star) -> DataFrame:
    """Turns as task lines, a quarter each good, commented out, broken and good again."""
    task = F.to_json(F.struct(
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("role").alias("nl"), F.col("text").alias("gold_sql")
    ))
    kind = F.col("turn") % 4
    line = F.when(kind == 1, F.concat(F.lit("# "), task)).when(kind == 2, F.concat(F.lit("{"), task)).otherwise(task)
    path = new_folder(star.spark, "tasks")
    star.table("conversations").select(line.alias("value")).write.text(path)
    return io.scan_tasks_jsonl(star.spark, path)[0].select("id", "nl", "gold_sql")


@query()
def extract_all(star: Star) -> DataFrame:
    names = [*STAR.tables, "absent"]
    datasets = {
        f"raw_{name}": lambda name=name: io.scan_parquet(
            star.spark, f"{star.path}/{name}.parquet", schema=STAR.tables.get(name)
        )
        for name in names
    }
    return extract(star.spark, datasets)[1]


def _build(star: Star, out: str) -> DataFrame:
    attributes = ["customer_name", "customer_segment", "customer_state"]
    customers = (
        star.customers(attributes)
        .join(star.signups(), "customer_id", "left")
        .withColumnsRenamed({"customer_segment": "segment", "customer_state": "state"})
    )
    return build(star.sales(marts.FACT_COLUMNS), customers, star.products(), star.as_of(), out)


@query()
def build_marts(star: Star) -> DataFrame:
    return _build(star, new_folder(star.spark, "marts"))


_BUILT: dict[tuple[str, str], str] = {}


def _written(star: Star, name: str) -> DataFrame:
    """A mart as the build wrote it; one build per application and source serves all marts."""
    key = (star.spark.sparkContext.applicationId, star.path)
    if not still_there(_BUILT.get(key)):
        out = new_folder(star.spark, "marts")
        _build(star, out)
        _BUILT[key] = out
    df = star.spark.read.parquet(f"{_BUILT[key]}/{name}")
    # shown like the marts themselves: money as DOUBLE; a folder's number is read as INT
    shown = {c: "double" for c, kind in df.dtypes if kind.startswith("decimal")} | ({"year": "long"} if "year" in df.columns else {})
    return df.withColumns({c: F.col(c).cast(kind) for c, kind in shown.items()})


for _name in (
    "fact_orders", "dim_customer", "fct_revenue_daily", "fct_kpis_monthly", "fct_product_performance", "fct_customer_cohorts",
):
    query(f"written_{_name}")(partial(_written, name=_name))


@query()
def catalog_audit(star: Star) -> DataFrame:
    return io.catalog_audit({name: star.table(name) for name in STAR.tables})


@query()
def parameterised_query(star: Star) -> DataFrame:
    star.table("orders").createOrReplaceTempView("tallywork_orders")
    return io.parameterised_query(
        star.spark,
        "SELECT o_orderpriority, count(*) AS orders FROM tallywork_orders "
        "WHERE o_totalprice > ? AND o_orderstatus = ? GROUP BY o_orderpriority",
        [100000.0, "F"],
    )


@query()
def split_train_val_test(star: Star) -> DataFrame:
    return configured.split_train_val_test(star.table("documents"), "doc_id").select("doc_id", "split")


@query()
def budget_check(star: Star) -> DataFrame:
    return configured.budget_check(query_log(star), ["approach"], max_tokens=100, max_seconds=0.9)


@query()
def latency_distribution(star: Star) -> DataFrame:
    found = configured.latency_distribution(query_log(star), "approach", "latency")
    return found.withColumn("latency", rounded(F.col("latency")))


@query()
def error_taxonomy(star: Star) -> DataFrame:
    return configured.error_taxonomy(query_log(star), ["approach"])
