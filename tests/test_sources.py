import pytest

from tallywork.etl import read_config, run_etl
from tallywork.plans import evaluation
from tallywork.plans.warehouse import extract_all
from tallywork.schema import RETAIL
from tallywork.session import shared_dir
from tallywork.sources import io
from tests.conftest import rows

ORDERS = """order_id,order_date,customer_id,product_id,quantity,price,region
1,2022-01-15,1,1,2,10.0,East
2,2022-02-20,1,2,1,5.0,West
"""
CUSTOMERS = """customer_id,customer_name,segment,state,signup_date
1,Ann,Corporate,TX,2022-01-01
"""
PRODUCTS = """product_id,product_name,category,cost
1,P,Furniture,4.0
2,Q,Technology,1.0
"""


@pytest.fixture
def raw(tmp_path):
    for name, body in (("orders", ORDERS), ("customers", CUSTOMERS), ("products", PRODUCTS)):
        (tmp_path / f"{name}.csv").write_text(body)
    return tmp_path


def test_csv_with_and_without_schema(spark, raw):
    path = str(raw / "orders.csv")
    declared = io.scan_csv(spark, path, "orders_csv", RETAIL.schema("orders"))
    assert dict(declared.dtypes)["order_date"] == "date"
    assert spark.table("orders_csv").count() == 2
    assert rows(io.scan_csv(spark, path)) == rows(declared)


def test_missing_and_bad_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.scan_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "bad.csv").write_text(ORDERS + "x,y,z,1,2,3,4\n")
    load = lambda: io.scan_csv(spark, str(tmp_path / "bad.csv"), schema=RETAIL.schema("orders"))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        load().collect()
    tables, report = extract_all(spark, {"bad": load, "good": lambda: spark.range(3)}, land=str(tmp_path / "landed"))
    assert list(tables) == ["good"]
    assert [(r.name, r.rows) for r in report.collect()] == [("bad", None), ("good", 3)]
    assert report.first().error


def test_etl_builds_all_marts(spark, raw, tmp_path):
    extracted, built = run_etl(spark, str(raw), str(tmp_path / "marts"))
    assert rows(extracted, "name", "rows") == [("customers", 1), ("orders", 2), ("products", 2)]
    assert {(r.name, r.rows, r.error) for r in built.collect()} == {
        ("fact_orders", 2, None), ("dim_customer", 1, None), ("fct_revenue_daily", 2, None),
        ("fct_kpis_monthly", 2, None), ("fct_product_performance", 2, None), ("fct_customer_cohorts", 2, None),
    }
    monthly = spark.read.parquet(str(tmp_path / "marts" / "fct_kpis_monthly"))
    assert rows(monthly, "region", "revenue", "aov") == [("East", 20.0, 20.0), ("West", 5.0, 5.0)]


def test_etl_from_a_configuration(spark, raw, tmp_path):
    columns = {t: [{"name": f.name, "type": k} for f, k in zip(RETAIL.schema(t), kinds)] for t, kinds in {
        "orders": "INTEGER DATE INTEGER INTEGER INTEGER DOUBLE VARCHAR".split(),
        "customers": "INTEGER VARCHAR VARCHAR VARCHAR DATE".split(), "products": "INTEGER VARCHAR VARCHAR DOUBLE".split(),
    }.items()}
    lines = ["project:", f"  warehouse_path: {tmp_path}/house.duckdb", "  datasets:"]
    lines += [f"    - {raw}/{t}.csv" for t in columns] + ["schema:"]
    for table, fields in columns.items():
        lines += [f"  {table}:", "    columns:"] + [f"      - {{name: {c['name']}, type: {c['type']}}}" for c in fields]
    (tmp_path / "project.yaml").write_text("\n".join(lines))
    paths, folder, registry = read_config(str(tmp_path / "project.yaml"))
    assert folder == f"{tmp_path}/house" and list(paths) == list(columns)
    extracted, built = run_etl(spark, "", folder, paths=paths, registry=registry)
    assert built.filter("error is not null").count() == 0
    assert spark.read.parquet(f"{folder}/fact_orders").count() == 2


def test_etl_reports_missing_tables(spark, raw, tmp_path):
    (raw / "elsewhere").mkdir()
    extracted, built = run_etl(spark, str(raw / "elsewhere"), str(tmp_path / "marts"))
    assert built is None
    assert {r.error for r in extracted.collect()} == {"not found"}


def test_tasks_skip_noise(spark, tmp_path):
    path = tmp_path / "tasks.jsonl"
    path.write_text(
        '{"id": "1", "nl": "a", "gold_sql": "SELECT 1", "checker": "execution"}\n\n# note\n{"id": "2", \n'
        '  {"id": "3", "nl": "b"}\nnot json\n'
    )
    tasks, rejected = io.scan_tasks_jsonl(spark, str(path))
    assert rows(tasks, "id", "gold_sql") == [("1", "SELECT 1"), ("3", None)]
    assert rejected.count() == 2


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", {"x": 1.0})], "name string, details map<string,double>")
    io.sink_json(df, str(tmp_path / "report"))
    assert rows(io.scan_json(spark, str(tmp_path / "report"), schema=df.schema)) == rows(df)
    io.sink_parquet(df, str(tmp_path / "p"))
    io.sink_parquet(df, str(tmp_path / "p"))  # overwrites
    assert io.scan_parquet(spark, str(tmp_path / "p")).count() == 1


def test_catalog(spark):
    spark.range(4).createOrReplaceTempView("four")
    audit = {r.table_name: r for r in io.catalog_audit({"four": io.registered_tables(spark)["four"]}).collect()}
    assert (audit["four"].row_count, audit["four"].columns) == (4, "id")
    assert io.sample_rows(spark.table("four"), 3).count() == 3
    assert io.table_info(spark.table("four")) == [("id", "bigint")]
    assert io.parameterised_query(spark, "SELECT count(*) n FROM four WHERE id >= ?", [2]).first().n == 2


def test_shared_dir_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_query_scores(spark):
    spark.createDataFrame([("E", 1.0), ("W", 2.0)], "region string, v double").createOrReplaceTempView("facts")
    gold = "SELECT region, SUM(v) AS total FROM facts GROUP BY region"
    right = evaluation.evaluate_query(spark, "t1", gold + " ORDER BY total", gold).first()
    assert (right.passed, right.score, right.execution_match) == (True, 1.0, True)
    assert right.token_cost == 2 * len((gold + " ORDER BY total").split())
    loose = evaluation.evaluate_query(spark, "t2", "SELECT * FROM facts", gold).first()
    assert (loose.passed, loose.score) == (False, pytest.approx(0.5 * 0.7 + 0.15))
    broken = evaluation.evaluate_query(spark, "t3", "SELECT nope FROM facts WHERE 1 = 1", gold).first()
    assert (broken.passed, broken.score) == (False, pytest.approx(0.3))
    alone = evaluation.evaluate_query(spark, "t4", gold).first()
    assert alone.execution_message == "No gold SQL provided" and not alone.passed


def test_kpi_properties_and_score(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "v double")
    props = lambda d, **kw: {r.property: r.passed for r in evaluation.kpi_properties(d, ["positive", "not_null", "range"], **kw).collect()}
    assert props(df) == {"positive": True, "not_null": True, "range": True}
    assert props(df, bounds=(0, 1))["range"] is False
    assert props(df.union(spark.sql("SELECT CAST(NULL AS DOUBLE)"))) == {"positive": False, "not_null": False, "range": True}
    assert not any(props(df.limit(0)).values())
    good = evaluation.evaluate_kpi(spark, "k", lambda: df, ["positive", "not_null"]).first()
    assert (good.passed, good.score) == (True, 1.0)
    bad = evaluation.evaluate_kpi(spark, "k", lambda: spark.table("no_such_table"), ["positive"]).first()
    assert (bad.passed, bad.score) == (False, 0.0)
    bare = evaluation.evaluate_kpi(spark, "k", lambda: df, []).first()
    assert (bare.passed, bare.score) == (True, 0.6)


def test_suite_reports_failures(spark):
    report = evaluation.suite_report(spark, {"a": lambda: spark.range(3), "b": lambda: spark.table("no_such_table")})
    assert rows(report, "task_id", "passed", "rows") == [("a", True, 3), ("b", False, None)]
    assert evaluation.suite_summary(report).first().pass_rate_pct == 50.0


def test_approach_summary_counts_errors_against_accuracy(spark):
    df = spark.createDataFrame([
        ("base", 0.9, 100, 1.0, None), ("base", 0.5, 200, 3.0, None),
        ("new", 0.9, 60, 1.0, None), ("new", 0.9, 999, 9.0, "boom"), ("dead", 0.9, 5, 1.0, "boom"),
    ], "approach string, score double, tokens long, latency double, error string")
    out = {r.approach: r for r in evaluation.approach_summary(df, "base").collect()}
    assert (out["base"].accuracy_pct, out["base"].avg_tokens, out["base"].avg_latency) == (50.0, 150.0, 2.0)
    assert (out["new"].accuracy_pct, out["new"].avg_tokens, out["new"].errors) == (50.0, 60.0, 1)
    assert out["new"].tokens_delta_pct == -60.0
    assert (out["dead"].accuracy_pct, out["dead"].avg_tokens, out["dead"].total_cost) == (0.0, 0.0, 0.0)


def test_scratch_tables_can_be_dropped(spark):
    import os

    from tallywork.session import drop_scratch, new_folder

    drop_scratch(spark)
    path = new_folder(spark, "scratch")
    spark.range(3).write.parquet(path)
    assert drop_scratch(spark) == 1 and not os.path.exists(path.removeprefix("file://"))
