"""Physical plans: built-in functions where asked for, and never a product."""

import pytest

from tallywork.llm import queries
from tests.conftest import DATA

NATIVE = ("op1_exact_dedup", "op6_pii", "op10_line_dedup")


def plan(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_run_no_python(spark, name):
    text = plan(spark, name)
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


@pytest.mark.parametrize("name", ["op2_mixing", "op4_simhash", "op8_suffix_array", "op9_quality_rules"])
def test_no_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "op6_pii")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
