"""Jobs over query logs, traces, answers and prompt components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.functions import lint, text
from tallywork.functions.numbers import ratio, rounded
from tallywork.operators.globalorder import with_position, with_previous


def lint_report(
    queries: DataFrame, sql: str = "sql", by: Sequence[str] = ("approach",),
    issues: Callable[[Column], Column] = lint.issues,
) -> DataFrame:
    """Count and share of queries per issue; the issue NULL counts the clean ones."""
    checked = queries.select(*by, issues(F.col(sql)).alias("issues"))
    totals = checked.groupBy(*by, "issues").agg(F.count(F.lit(1)).alias("n"))
    # one row per set of issues by now; a window keeps groups that are NULL
    of_total = F.sum("n").over(Window.partitionBy(*by))
    return (
        totals.select(*by, "issues", "n", of_total.alias("of_total"))
        .select(*by, F.explode_outer("issues").alias("issue"), "n", "of_total")
        .groupBy(*by, "issue")
        .agg(F.sum("n").alias("queries"), F.max("of_total").alias("of_total"))
        .select(*by, "issue", "queries", rounded(ratio(F.col("queries"), F.col("of_total"))).alias("share"))
    )


# The rules mined from traces, as (rule_id, pattern, action).
FAILURE_RULES = {
    "cross_join": (
        "avoid_unfiltered_cross_join", "CROSS JOIN without WHERE clause",
        "Add WHERE clause or use INNER/LEFT JOIN instead",
    ),
    "group_by": (
        "add_group_by", "Aggregate function without GROUP BY",
        "Add GROUP BY for non-aggregated columns in SELECT",
    ),
    "ambiguous": (
        "qualify_columns", "Ambiguous column reference", "Qualify column names with table aliases",
    ),
    "unknown": (
        "check_schema", "Unknown table or column", "Verify identifiers against schema before using",
    ),
}
SUCCESS_RULES = {
    "explicit": (
        "use_explicit_columns", "SELECT with explicit column list",
        "Continue using explicit column selection",
    ),
    "inner_join": (
        "prefer_inner_join", "Using INNER JOIN", "Prefer INNER JOIN for better performance",
    ),
    "aggregation": (
        "proper_group_by", "Correct GROUP BY with aggregates", "Continue proper GROUP BY usage",
    ),
}
MIN_SUPPORT = 2
SUCCESS_SHARE = 0.7
MIN_CONFIDENCE = 0.5


def _mine(traces: DataFrame, flags: dict[str, Column], rules: dict[str, tuple[str, str, str]]) -> DataFrame:
    """One pass counts every pattern; the counts unfold to one rule row each."""
    counted = traces.agg(
        F.count(F.lit(1)).alias("traces"),
        *[F.count_if(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in flags.items()],
    )
    rows = [
        F.struct(
            *[F.lit(v).alias(k) for k, v in zip(("rule_id", "pattern", "action"), rules[name])],
            ratio(F.col(name), F.col("traces")).alias("confidence"),
            F.col(name).alias("support"),
            F.array().cast("array<string>").alias("examples"),
        )
        for name in flags
    ]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mine_failure_rules(traces: DataFrame) -> DataFrame:
    """Error patterns seen at least twice; confidence is their share of the failures."""
    error = F.lower("error")
    flags = {
        "cross_join": lint.unfiltered_cross_join(F.col("generated_sql")),
        "group_by": F.contains(error, F.lit("group by")),
        "ambiguous": F.contains(error, F.lit("ambiguous")),
        "unknown": F.contains(error, F.lit("does not exist")) | F.contains(error, F.lit("unknown")),
    }
    failed = traces.filter(~F.coalesce("passed", F.lit(False)))
    return _mine(failed, flags, FAILURE_RULES).filter(F.col("support") >= MIN_SUPPORT)


def mine_success_rules(traces: DataFrame) -> DataFrame:
    """Practices in at least 70 % of the successes; traces without SQL show none."""
    sql = F.col("generated_sql")
    aggregates = lint.has(sql, "SUM(") | lint.has(sql, "AVG(")
    flags = {
        "explicit": ~lint.has(sql, "SELECT *"),
        "inner_join": lint.has(sql, "INNER JOIN"),
        "aggregation": lint.has(sql, "GROUP BY") & aggregates,
    }
    return _mine(traces.filter("passed"), flags, SUCCESS_RULES).filter(F.col("confidence") >= SUCCESS_SHARE)


def filter_rules(
    rules: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT
) -> DataFrame:
    return rules.filter((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support))


def token_budget(df: DataFrame, column: str, by: Sequence[str], rationale: str | None = None) -> DataFrame:
    """Estimated tokens per group: words·2 (plus the rationale's words) and words·1.3 cut off."""
    words = text.word_count(F.col(column))
    doubled = words * 2
    if rationale:
        doubled = doubled + text.word_count(F.col(rationale))
    estimated = df.select(
        *by, words.alias("w"), doubled.alias("d"), F.floor(words * F.lit(1.3)).cast("long").alias("s")
    )
    return estimated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum("w").alias("words"),
        F.sum("d").alias("tokens_double"),
        F.sum("s").alias("tokens_scaled"),
        ratio(F.sum("d"), F.count("d")).alias("avg_tokens"),
        F.max("d").alias("max_tokens"),
    )


def extract_fenced_sql(answers: DataFrame, column: str = "answer") -> DataFrame:
    return answers.withColumn("extracted_sql", text.fenced_sql(F.col(column)))


def extraction_yield(extracted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: answers, fenced ones, those with SQL left after extraction."""
    return extracted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if(F.contains("answer", F.lit("```"))).alias("fenced"),
        F.count_if(F.length("extracted_sql") > 0).alias("extracted"),
    )


def table_usage(queries: DataFrame, tables: Sequence[str], sql: str = "sql") -> DataFrame:
    """Queries mentioning each known table, as a whole word: one scan, no join."""
    counted = queries.agg(*[
        F.count_if(F.coalesce(F.col(sql).rlike(rf"(?i)\b{name}\b"), F.lit(False))).alias(name)
        for name in tables
    ])
    rows = [F.struct(F.lit(t).alias("table_name"), F.col(t).alias("queries")) for t in tables]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Component types and the prompt sections they go to.
SECTIONS = {"system": "system", "fewshot": "fewshots", "tool_hint": "tool_hints", "guard": "guards"}


def prompt_by_type(
    components: DataFrame, owner: str, order: str, kind: str, content: str,
    sections: dict[str, str] = SECTIONS,
) -> DataFrame:
    """Components sorted into prompt sections, numbered in order within owner and section.

    Rows, not lists: a section may be of any length. Other types are left out.
    """
    section = F.create_map(*[F.lit(v) for pair in sections.items() for v in pair])[F.col(kind)]
    sorted_in = components.select(
        owner, section.alias("section"), order, F.col(content).alias("text")
    ).filter(F.col("section").isNotNull())
    numbered = with_position(sorted_in, [F.col(order)], "position", [owner, "section"])
    return numbered.select(owner, "section", "position", "text")


def duplicate_components(components: DataFrame, name: str, content: str) -> DataFrame:
    """Contents shared by several components, found by their whole digest and shown by its first 32 bits.

    Only the digests travel, never the texts.
    """
    return (
        components.select(text.content_digest(F.col(name), F.col(content)).alias("digest"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .select(text.digest_key(F.col("digest")).alias("content_key"), "copies")
    )


def fewshot_pairs(components: DataFrame, content: str = "text") -> DataFrame:
    """Distinct (task, SQL) pairs of "Task: …" / "SQL: …" examples of two lines or more.

    A literal backslash-n counts as a line break.
    """
    lines = F.split(F.replace(F.col(content), F.lit("\\n"), F.lit("\n")), "\n")
    parts = components.select(lines.alias("lines")).filter(F.size("lines") >= 2)
    return parts.select(
        text.strip(F.replace(F.get("lines", F.lit(0)), F.lit("Task:"), F.lit(""))).alias("nl"),
        text.strip(F.replace(F.get("lines", F.lit(1)), F.lit("SQL:"), F.lit(""))).alias("sql"),
    ).distinct()


def dialogue_pairs(turns: DataFrame, conversation: str, order: str, role: str, content: str) -> DataFrame:
    """conversation, order, nl, sql: each answer with the question right before it, fences and outer white space removed.

    A question is a ``user`` turn and an answer the next turn of the conversation if it is the ``assistant``'s. Turns find
    their neighbour across partitions, so a conversation may be of any length. Null texts count as empty; of turns that
    repeat an order the text decides which comes first.
    """
    read = turns.select(conversation, order, role, F.coalesce(content, F.lit("")).alias("text"))
    near = with_previous(read, [F.col(order), F.col("text"), F.col(role)], [role, "text"], "previous", [conversation])
    answers = near.filter((F.col(role) == "assistant") & (F.col(f"previous.{role}") == "user"))
    return answers.select(
        conversation, order, text.strip(F.col("previous.text")).alias("nl"), text.fenced_sql(F.col("text")).alias("sql")
    )


def grade(graded: DataFrame) -> DataFrame:
    """``raw_score`` text, ``syntax_ok``, ``anti_patterns`` count → ``score``, ``passed``."""
    raw = F.when(text.is_number(F.col("raw_score")), F.col("raw_score").try_cast("double") / 10)
    score = F.coalesce(raw, F.lit(0.5))
    score = score * F.when(F.col("syntax_ok"), F.lit(1.0)).otherwise(F.lit(0.3))
    score = score * F.when(F.col("anti_patterns") > 0, F.lit(0.9)).otherwise(F.lit(1.0))
    scored = graded.withColumn("score", score)
    return scored.withColumn("passed", (F.col("score") >= 0.7) & F.col("syntax_ok"))


def grade_kpi(graded: DataFrame) -> DataFrame:
    """``raw_score`` text and an optional ``test_pass_rate`` → ``score``, ``passed``."""
    raw = F.when(text.is_number(F.col("raw_score")), F.col("raw_score").try_cast("double") / 10)
    score = F.coalesce(raw, F.lit(0.5))
    tested = score * 0.7 + F.col("test_pass_rate") * 0.3
    scored = graded.withColumn("score", F.coalesce(tested, score))
    return scored.withColumn("passed", F.col("score") >= 0.7)


def grade_summary(graded: DataFrame, by: Sequence[str]) -> DataFrame:
    return graded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("graded"),
        ratio(F.sum(F.col("score").cast("decimal(18,9)")), F.count("score")).alias("mean_score"),
        rounded(ratio(F.count_if("passed"), F.count(F.lit(1)))).alias("pass_rate"),
    )
