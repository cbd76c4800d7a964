import pytest
from pyspark.sql import functions as F

from tallywork.functions import lint, text
from tallywork.operators import configured, textjobs
from tests.conftest import rows


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("value, count", [
    ("", 0), ("  \n\t ", 0), ("a", 1), (" a  b c d\n", 4), ("x\x0by", 2), ("é ü", 2),
])
def test_word_count(spark, value, count):
    assert one(spark, value, text.word_count) == count == len(value.split())


@pytest.mark.parametrize("answer", [
    "```sql\nSELECT 1\n```", "Sure:\n```sql\nSELECT 1\n```\nand\n```sql\nSELECT 2```", "```\nSELECT 1\n```",
    "text ```SELECT 1", "  SELECT 1 \n", "```sql\nSELECT 1",
])
def test_fenced_sql(spark, answer):
    assert one(spark, answer, text.fenced_sql) == "SELECT 1"


def test_content_key(spark):
    import hashlib

    df = spark.createDataFrame([("n", "some text")], "n string, t string")
    want = int(hashlib.md5(b"n:some text").hexdigest()[:8], 16)
    assert df.select(text.content_key(F.col("n"), F.col("t"))).first()[0] == want


@pytest.mark.parametrize("sql, issues, ext", [
    ("SELECT * FROM t WHERE a = 1", {lint.STAR_SELECT}, {lint.EXT_STAR_SELECT}),
    ("select a from t", {lint.FULL_SCAN}, set()),
    ("SELECT a FROM t CROSS JOIN u", {lint.CROSS_JOIN}, {lint.EXT_CROSS_JOIN}),
    ("SELECT a FROM t CROSS JOIN u WHERE t.x = u.x", set(), set()),
    ("SELECT region FROM t JOIN u USING (k) WHERE region > 'A'", set(), set()),  # no ON: REGION only contains it
    ("SELECT t.a FROM t JOIN u ON t.a = u.a WHERE u.b < 3", set(), {lint.EXT_NON_EQUI}),
    ("SELECT a FROM t LIMIT 5", set(), set()),
    ("SELECT a, COUNT(b) FROM t GROUP BY a", set(), set()),
])
def test_lint(spark, sql, issues, ext):
    assert set(one(spark, sql, lint.issues)) == issues
    assert set(one(spark, sql, lint.issues_ext)) == ext


TRACE = "passed boolean, generated_sql string, error string"


def test_failure_rules_need_support(spark):
    traces = spark.createDataFrame([
        (False, "SELECT 1", "column must appear in GROUP BY"),
        (False, "SELECT 1", "Ambiguous column"),
        (False, "SELECT 1", "ambiguous name"),
        (False, "SELECT a FROM b CROSS JOIN c", None),
        (None, "SELECT a FROM b cross join c", "table t does not exist"),
        (True, "SELECT a FROM b CROSS JOIN c", "unknown"),
    ], TRACE)
    mined = textjobs.mine_failure_rules(traces)
    assert rows(mined, "rule_id", "support", "confidence") == [
        ("avoid_unfiltered_cross_join", 2, 0.4), ("qualify_columns", 2, 0.4),
    ]
    assert textjobs.filter_rules(mined).count() == 0
    assert textjobs.filter_rules(mined, min_confidence=0.4).count() == 2


def test_success_rules_need_seventy_percent(spark):
    joins = [(True, "SELECT a FROM t INNER JOIN u USING (k)", None)] * 7
    others = [(True, "SELECT * FROM t", None)] * 2 + [(True, None, None)]
    mined = textjobs.mine_success_rules(spark.createDataFrame(joins + others, TRACE))
    assert rows(mined, "rule_id", "support") == [("prefer_inner_join", 7), ("use_explicit_columns", 7)]
    assert textjobs.mine_success_rules(spark.createDataFrame([], TRACE)).count() == 0


def test_fewshot_accepts_both_line_breaks(spark):
    data = [("Task: A\nSQL: SELECT 1",), ("Task: A\\nSQL: SELECT 1",), ("Task: B",), ("Task: C\nSQL: x\nmore",)]
    out = textjobs.fewshot_pairs(spark.createDataFrame(data, "text string"))
    assert rows(out) == [("A", "SELECT 1"), ("C", "x")]


def test_grades(spark):
    df = spark.createDataFrame(
        [("8", True, 0), ("8", True, 2), ("9", False, 0), ("good", True, 0), ("1d", True, 0)],
        "raw_score string, syntax_ok boolean, anti_patterns int",
    )
    out = [(round(r.score, 6), r.passed) for r in textjobs.grade(df).collect()]
    assert out == [(0.8, True), (0.72, True), (0.27, False), (0.5, False), (0.5, False)]
    kpi = spark.createDataFrame([("10", 0.0), ("6", 1.0), ("7", None)], "raw_score string, test_pass_rate double")
    out = [(round(r.score, 6), r.passed) for r in textjobs.grade_kpi(kpi).collect()]
    assert out == [(0.7, True), (0.72, True), (0.7, True)]


def test_prompt_sections_skip_other_types(spark):
    df = spark.createDataFrame(
        [("g", 1, "system", "s1"), ("g", 2, "fewshot", "f1"), ("g", 3, "other", "x"), ("g", 4, "system", "s2"),
         ("h", 1, "guard", "w")],
        "genome string, ord int, component_type string, text string",
    )
    out = textjobs.prompt_by_type(df, "genome", "ord", "component_type", "text")
    assert rows(out) == [
        ("g", "fewshots", 1, "f1"), ("g", "system", 1, "s1"), ("g", "system", 2, "s2"), ("h", "guards", 1, "w"),
    ]


def test_table_usage_matches_whole_words(spark):
    df = spark.createDataFrame([("SELECT 1 FROM fact_orders",), ("select 1 from ORDERS o",), (None,)], "sql string")
    assert rows(textjobs.table_usage(df, ["orders", "fact_orders"])) == [("fact_orders", 1), ("orders", 1)]


def test_split_shares(spark):
    out = configured.split_train_val_test(spark.range(4000), "id").groupBy("split").count()
    share = {r.split: r["count"] / 4000 for r in out.collect()}
    assert share["train"] == pytest.approx(0.7, abs=0.03) and share["val"] == pytest.approx(0.15, abs=0.03)
