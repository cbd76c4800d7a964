"""Query-log, trace, answer and component jobs."""

from oracle.querylog import CROSS, LOG, NON_EQUI, SCAN, STAR_SELECT

ISSUES = {
    "Uses SELECT * instead of explicit columns": STAR_SELECT,
    "CROSS JOIN without WHERE clause": CROSS,
    "Potential full table scan without filter": SCAN,
}
ISSUES_EXT = {
    "Avoid SELECT * - specify columns explicitly": STAR_SELECT,
    "CROSS JOIN without WHERE clause may cause cartesian product": CROSS,
    "Non-equi join detected - verify performance": NON_EQUI,
}
SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^[{SPACE}]+|[{SPACE}]+\\z', '', 'g')"


def words(expression: str) -> str:
    return f"CAST(len(regexp_extract_all({expression}, '[^{SPACE}]+')) AS BIGINT)"


def lint(issues: dict[str, str]) -> str:
    found = " UNION ALL ".join(
        f"SELECT approach, '{text}' AS issue FROM log WHERE {flag}" for text, flag in issues.items()
    )
    none = " OR ".join(issues.values())
    return f"""WITH {LOG}, found AS ({found} UNION ALL SELECT approach, NULL FROM log WHERE NOT ({none})),
      totals AS (SELECT approach, COUNT(*) AS n FROM log GROUP BY 1)
      SELECT approach, issue, COUNT(*) AS queries, round(CAST(COUNT(*) AS DOUBLE) / any_value(n), 6) AS share
      FROM found JOIN totals USING (approach) GROUP BY 1, 2"""



def mined(keep: str) -> str:
    """Rules of one and two words: in 5 % of an outcome, and twice as often as in the other."""
    side = """SELECT {good} AS good, words, {own} AS support, {own} / CAST(greatest(size_{own}, 1) AS DOUBLE) AS share,
      {other} / CAST(greatest(size_{other}, 1) AS DOUBLE) AS other_share, {own} / CAST(failed + passed AS DOUBLE) AS confidence,
      size_{own} AS size, {own}_ids AS ids FROM counted, sizes"""
    sides = " UNION ALL ".join(
        side.format(good=good, own=own, other=other) for good, own, other in (("true", "passed", "failed"), ("false", "failed", "passed"))
    )
    return rf"""WITH t AS (
        SELECT doc_id, coalesce(quality = 1, false) AS good, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) AS words
        FROM labels JOIN documents USING (doc_id)),
      sizes AS (SELECT count(*) FILTER (NOT good) AS size_failed, count(*) FILTER (good) AS size_passed FROM t),
      w AS (SELECT doc_id, good, unnest(words) AS word FROM t),
      often AS (SELECT word FROM w, sizes GROUP BY word HAVING count(*) FILTER (good) >= CAST(0.05 AS DOUBLE) * any_value(size_passed)
        OR count(*) FILTER (NOT good) >= CAST(0.05 AS DOUBLE) * any_value(size_failed)),
      f AS (SELECT * FROM w SEMI JOIN often USING (word)),
      sets AS (SELECT doc_id, good, word AS words FROM f UNION ALL
        SELECT a.doc_id, a.good, a.word || ' ' || b.word FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.word < b.word),
      counted AS (SELECT words, count(*) FILTER (NOT good) AS failed, count(*) FILTER (good) AS passed,
        list_sort(list(doc_id) FILTER (NOT good))[1:3] AS failed_ids, list_sort(list(doc_id) FILTER (good))[1:3] AS passed_ids FROM sets GROUP BY 1)
      SELECT CASE WHEN good THEN 'keep:' ELSE 'avoid:' END || words AS rule_id, words AS pattern,
        CASE WHEN good THEN 'prefer' ELSE 'avoid' END AS action, round(confidence, 6) AS confidence, support, round(share, 6) AS share,
        round(other_share, 6) AS other_share, array_to_string(ids, ',') AS examples
      FROM ({sides}) WHERE support > 0 AND support >= CAST(0.05 AS DOUBLE) * size AND share >= CAST(2 AS DOUBLE) * other_share AND {keep}"""


BUDGET = """COUNT(*) AS texts, CAST(SUM(w) AS BIGINT) AS words, CAST(SUM(d) AS BIGINT) AS tokens_double,
  CAST(SUM(s) AS BIGINT) AS tokens_scaled, CAST(SUM(d) AS DOUBLE) / COUNT(d) AS avg_tokens, MAX(d) AS max_tokens"""
SCALED = "CAST(floor({w} * CAST(1.3 AS DOUBLE)) AS BIGINT)"
ANSWERS = """answers AS (SELECT *, coalesce(text, '') AS answer FROM conversations), extracted AS (SELECT *, """ + strip(
    """CASE WHEN contains(answer, '```sql') THEN split_part(split_part(answer, '```sql', 2), '```', 1)
      WHEN contains(answer, '```') THEN split_part(split_part(answer, '```', 2), '```', 1) ELSE answer END"""
) + " AS extracted_sql FROM answers)"
RAW = "CAST(coalesce(TRY_CAST(raw_score AS DOUBLE) / 10, CAST(0.5 AS DOUBLE)) AS DOUBLE)"
GRADED = f"""{LOG}, graded AS (SELECT approach,
  CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(user_id % 11 AS VARCHAR) END AS raw_score,
  event_id % 7 <> 0 AS syntax_ok, {STAR_SELECT} OR {CROSS} OR {NON_EQUI} AS flawed,
  CASE WHEN event_id % 3 = 0 THEN (event_id % 10) / CAST(10 AS DOUBLE) END AS test_pass_rate FROM log)"""
GRADE = """SELECT approach, COUNT(*) AS graded, CAST(SUM(CAST(score AS DECIMAL(18,9))) AS DOUBLE) / COUNT(score) AS mean_score,
  round(CAST(COUNT(*) FILTER (WHERE passed) AS DOUBLE) / COUNT(*), 6) AS pass_rate FROM g GROUP BY 1"""

SQL = {
    "lint_report": lint(ISSUES),
    "lint_report_ext": lint(ISSUES_EXT),
    "mine_failure_rules": mined("NOT good"),
    "mine_success_rules": mined("good"),
    "filter_rules": mined("confidence >= CAST(0.5 AS DOUBLE) AND support >= 2"),
    "token_budget": f"""WITH e AS (SELECT source, lang, {words('text')} AS w FROM documents),
      f AS (SELECT *, w * 2 AS d, {SCALED.format(w='w')} AS s FROM e)
      SELECT source, lang, {BUDGET} FROM f GROUP BY 1, 2""",
    "token_budget_with_rationale": f"""WITH {LOG},
      e AS (SELECT approach, {words('sql')} AS w, {words("coalesce(error, 'as asked')")} AS r FROM log),
      f AS (SELECT *, w * 2 + r AS d, {SCALED.format(w='w')} AS s FROM e) SELECT approach, {BUDGET} FROM f GROUP BY 1""",
    "extract_fenced_sql": f"WITH {ANSWERS} SELECT conv_id, turn, extracted_sql FROM extracted WHERE role = 'assistant'",
    "extraction_yield": f"""WITH {ANSWERS} SELECT role, COUNT(*) AS answers,
      COUNT(*) FILTER (WHERE contains(answer, '```')) AS fenced,
      COUNT(*) FILTER (WHERE length(extracted_sql) > 0) AS extracted FROM extracted GROUP BY 1""",
    "table_usage": r"""WITH names AS (SELECT DISTINCT lower(name) AS name FROM (SELECT c_name AS name FROM customer
        UNION ALL SELECT p_name FROM part UNION ALL SELECT text FROM benchmark) WHERE name <> ''),
      texts AS (SELECT lower(text) AS text FROM documents UNION ALL SELECT lower(text) FROM conversations),
      near AS MATERIALIZED (SELECT name, text FROM names JOIN texts ON contains(text, name)),
      found AS (SELECT name, count(*) AS texts FROM near WHERE regexp_matches(text,
        CASE WHEN regexp_matches(name, '^\w') THEN '\b' ELSE '' END || regexp_escape(name) || CASE WHEN regexp_matches(name, '\w$') THEN '\b' ELSE '' END)
        GROUP BY 1)
      SELECT name, coalesce(texts, 0) AS texts FROM names LEFT JOIN found USING (name)""",
    "prompt_by_type": """SELECT conv_id, section, row_number() OVER (PARTITION BY conv_id, section ORDER BY turn) AS position,
      text FROM (SELECT *, CASE role WHEN 'system' THEN 'system' WHEN 'user' THEN 'fewshots' WHEN 'assistant' THEN 'guards' END
        AS section FROM conversations) WHERE section IS NOT NULL""",
    "duplicate_components": """SELECT CAST('0x' || substr(md5(lang || ':' || text), 1, 8) AS BIGINT) AS content_key,
      COUNT(*) AS copies FROM documents GROUP BY 1 HAVING COUNT(*) > 1""",
    "fewshot_pairs": f"""WITH {ANSWERS}, n AS (SELECT role, extracted_sql AS sql, lag(role) OVER w AS before, lag(answer) OVER w AS question
        FROM extracted WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT DISTINCT {strip("question")} AS nl, sql FROM n WHERE role = 'assistant' AND before = 'user'""",
    "grade_summary": f"""WITH {GRADED}, s AS (SELECT *, {RAW} * CASE WHEN syntax_ok THEN CAST(1 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END
        * CASE WHEN flawed THEN CAST(0.9 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS score FROM graded),
      g AS (SELECT *, score >= CAST(0.7 AS DOUBLE) AND syntax_ok AS passed FROM s) {GRADE}""",
    "grade_summary_kpi": f"""WITH {GRADED}, s AS (SELECT *, coalesce({RAW} * CAST(0.7 AS DOUBLE)
        + test_pass_rate * CAST(0.3 AS DOUBLE), {RAW}) AS score FROM graded),
      g AS (SELECT *, score >= CAST(0.7 AS DOUBLE) AS passed FROM s) {GRADE}""",
}
