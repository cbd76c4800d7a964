"""Query-log, trace, answer and component queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions import lint
from tallywork.functions.numbers import rounded
from tallywork.operators import textjobs
from tallywork.operators.mentions import mentions
from tallywork.operators.rulemining import mine_rules
from tallywork.plans.registry import query
from tallywork.sources.querylog import query_log
from tallywork.sources.star import Star


@query()
def lint_report(star: Star) -> DataFrame:
    return textjobs.lint_report(query_log(star))


@query()
def lint_report_ext(star: Star) -> DataFrame:
    return textjobs.lint_report(query_log(star), issues=lint.issues_ext)


def _traces(star: Star) -> DataFrame:
    """Documents whose quality is labelled; good ones passed."""
    return star.table("labels").join(star.table("documents"), "doc_id").select(
        F.col("doc_id").alias("id"), "text", (F.col("quality") == 1).alias("passed")
    )


def _flat(rules: DataFrame) -> DataFrame:
    words, good = F.array_join("words", " "), F.col("passed")
    return rules.select(
        F.concat(F.when(good, "keep:").otherwise("avoid:"), words).alias("rule_id"), words.alias("pattern"),
        F.when(good, "prefer").otherwise("avoid").alias("action"), rounded(F.col("confidence")).alias("confidence"), "support",
        rounded(F.col("share")).alias("share"), rounded(F.col("other_share")).alias("other_share"),
        F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"),
    )


@query()
def mine_failure_rules(star: Star) -> DataFrame:
    """Words and pairs of words that mark documents of low quality."""
    return _flat(mine_rules(_traces(star), outcomes=[False]))


@query()
def mine_success_rules(star: Star) -> DataFrame:
    """Words and pairs of words that mark documents of good quality."""
    return _flat(mine_rules(_traces(star), outcomes=[True]))


@query()
def filter_rules(star: Star) -> DataFrame:
    return _flat(textjobs.filter_rules(mine_rules(_traces(star))))


@query()
def token_budget(star: Star) -> DataFrame:
    return textjobs.token_budget(star.table("documents"), "text", ["source", "lang"])


@query()
def token_budget_with_rationale(star: Star) -> DataFrame:
    log = query_log(star).withColumn("rationale", F.coalesce("error", F.lit("as asked")))
    return textjobs.token_budget(log, "sql", ["approach"], rationale="rationale")


def _answers(star: Star) -> DataFrame:
    return star.table("conversations").withColumn("answer", F.coalesce("text", F.lit("")))


@query()
def extract_fenced_sql(star: Star) -> DataFrame:
    """What the assistant's turns hold once fences are taken off."""
    answers = _answers(star).filter("role = 'assistant'")
    return textjobs.extract_fenced_sql(answers).select("conv_id", "turn", "extracted_sql")


@query()
def extraction_yield(star: Star) -> DataFrame:
    return textjobs.extraction_yield(textjobs.extract_fenced_sql(_answers(star)), ["role"])


@query()
def table_usage(star: Star) -> DataFrame:
    """Documents and turns that mention each customer, part or benchmark passage."""
    names = star.table("customer").select(F.col("c_name").alias("name")).union(star.table("part").select("p_name"))
    texts = star.table("documents").select("text").union(star.table("conversations").select("text"))
    return mentions(texts, "text", names.union(star.table("benchmark").select("text")), "name")


@query()
def prompt_by_type(star: Star) -> DataFrame:
    """Turns of each conversation sorted into sections by role."""
    roles = {"system": "system", "user": "fewshots", "assistant": "guards"}
    return textjobs.prompt_by_type(star.table("conversations"), "conv_id", "turn", "role", "text", roles)


@query()
def duplicate_components(star: Star) -> DataFrame:
    return textjobs.duplicate_components(star.table("documents"), "lang", "text")


@query()
def fewshot_pairs(star: Star) -> DataFrame:
    """Questions and answers of neighbouring turns."""
    return textjobs.dialogue_pairs(star.table("conversations"), "conv_id", "turn", "role", "text").select("nl", "sql").distinct()


def _graded(star: Star) -> DataFrame:
    return query_log(star).select(
        "approach",
        F.when(F.col("event_type") == "error", "n/a").otherwise((F.col("user_id") % 11).cast("string")).alias("raw_score"),
        (F.col("event_id") % 7 != 0).alias("syntax_ok"),
        F.size(lint.issues_ext(F.col("sql"))).alias("anti_patterns"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 10 / F.lit(10.0)).alias("test_pass_rate"),
    )


@query()
def grade_summary(star: Star) -> DataFrame:
    return textjobs.grade_summary(textjobs.grade(_graded(star)), ["approach"])


@query()
def grade_summary_kpi(star: Star) -> DataFrame:
    return textjobs.grade_summary(textjobs.grade_kpi(_graded(star)), ["approach"])
