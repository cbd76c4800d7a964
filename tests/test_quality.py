import pytest

from tallywork.operators import quality as q
from tallywork.schema import RETAIL, SchemaRegistry


def by_name(report):
    return {r.name: r for r in report.collect()}


def test_null_share_and_uniqueness(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (2, 3), (None, 4)], "a int, b int")
    out = by_name(q.run_checks("t", df, [
        q.NotNull("a"), q.NotNull("b", 0.75), q.Unique("a"), q.Unique("b"), q.InRange("b", 1, 3),
    ]))
    assert not out["not_null_t.a"].passed and out["not_null_t.b"].passed
    assert out["not_null_t.b"].message == "b: 75.0% non-null (threshold: 75.0%)"
    # the NULL counts as a duplicate
    assert out["unique_t.b"].message == "b: 3 unique of 4 total" and not out["unique_t.b"].passed
    assert out["unique_t.a"].details == {"total": 4.0, "unique": 2.0, "duplicates": 2.0}
    assert out["range_t.b"].message == "b: 2/3 in range [1, 3]"
    assert out["range_t.b"].details["actual_max"] == 4.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int")
    out = by_name(q.run_checks("t", df, [q.NotNull("a"), q.Unique("a"), q.InRange("a", 0)]))
    assert not out["not_null_t.a"].passed
    assert out["unique_t.a"].passed and out["range_t.a"].passed
    assert out["range_t.a"].details["actual_min"] is None


def test_range_without_bounds_passes(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert q.run_checks("t", df, [q.InRange("a")]).first().passed


def test_foreign_key_ignores_null(spark):
    child = spark.createDataFrame([(1,), (None,), (9,), (9,)], "p int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    row = q.check_foreign_key("child", child, q.ForeignKey("p", "parent", "id"), parent).first()
    assert not row.passed and row.details == {"orphaned_count": 2.0}
    assert row.message == "p → parent.id: 2 orphaned rows"


def test_table_exists_and_summary(spark):
    spark.range(3).createOrReplaceTempView("here")
    report = q.check_table_exists(spark, "here").unionByName(q.check_table_exists(spark, "gone"))
    assert [r.message for r in report.collect()] == ["Table 'here' exists", "Table 'gone' not found"]
    assert tuple(q.summary(report).first()) == (2, 1, 1, 0.5)
    assert tuple(q.summary(report.limit(0)).first()) == (0, 0, 0, 0.0)


def test_registry():
    assert RETAIL.primary_keys("orders") == ["order_id"]
    assert RETAIL.foreign_keys("orders") == {
        "customer_id": "customers.customer_id", "product_id": "products.product_id",
    }
    assert RETAIL.columns("products") == ["product_id", "product_name", "category", "cost"]
    assert '"pk":true' in RETAIL.to_json()["orders"]


def test_registry_from_yaml(tmp_path):
    yaml = pytest.importorskip("yaml")
    text = """
schema:
  t:
    columns:
      - {name: id, type: INTEGER, pk: true}
      - {name: ref, type: VARCHAR, fk: other.id}
"""
    registry = SchemaRegistry.from_config(yaml.safe_load(text)["schema"])
    assert registry.primary_keys("t") == ["id"] and registry.foreign_keys("t") == {"ref": "other.id"}
