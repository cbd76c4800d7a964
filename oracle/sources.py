"""Scans, sinks, loading and configured reports."""

from oracle.marts import SQL as MARTS
from oracle.querylog import LOG
from tallywork.schema import STAR

COUNTS = " UNION ALL ".join(
    f"SELECT 'raw_{t}' AS name, COUNT(*) AS rows, CAST(NULL AS VARCHAR) AS error FROM {t}" for t in STAR.tables
)


def state(used: str, budget: int) -> str:
    return f"CASE WHEN {used} > {budget} THEN 'exceeded' WHEN {used} >= {budget * 8 // 10} THEN 'alert' ELSE 'ok' END"


KIND = """CASE WHEN contains(lower(error), 'group by') THEN 'missing_group_by'
  WHEN contains(lower(error), 'ambiguous') THEN 'ambiguous_column'
  WHEN contains(lower(error), 'does not exist') OR contains(lower(error), 'unknown') THEN 'unknown_identifier'
  ELSE 'other' END"""

SQL = {
    "scan_parquet": "SELECT * FROM orders",
    "scan_csv": "SELECT * FROM part",
    "sink_csv": "SELECT * FROM conversations",
    "sink_parquet": "SELECT * FROM customer",
    "scan_json": "SELECT * FROM supplier",
    "scan_tasks_jsonl": """SELECT conv_id || '_' || turn AS id, role AS nl, text AS gold_sql FROM conversations
      WHERE turn % 4 NOT IN (1, 2)""",
    "extract_all": f"{COUNTS} UNION ALL SELECT 'raw_absent', NULL, 'not found'",
    "build_marts": " UNION ALL ".join(
        f"SELECT '{k}' AS name, COUNT(*) AS rows, CAST(NULL AS VARCHAR) AS error FROM ({sql})" for k, sql in MARTS.items()),
    # What the build wrote, compared by content.
    **{f"written_{k}": sql for k, sql in MARTS.items()},
    # Built batch by batch, they hold the same rows.
    "incremental_revenue_daily": MARTS["fct_revenue_daily"],
    "incremental_kpis_monthly": MARTS["fct_kpis_monthly"],
    "catalog_audit": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, COUNT(*) AS row_count, CAST({len(s.names)} AS INT) AS column_count,
          '{", ".join(s.names)}' AS columns FROM {t}""" for t, s in STAR.tables.items()),
    "parameterised_query": """SELECT o_orderpriority, COUNT(*) AS orders FROM orders
      WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY 1""",
    "split_train_val_test": """SELECT doc_id, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS split
      FROM (SELECT doc_id, CAST('0x' || substr(md5(doc_id || '|42'), 1, 8) AS BIGINT) % 100 AS b FROM documents)""",
    "budget_check": f"""WITH {LOG}, s AS (SELECT approach, COUNT(*) FILTER (WHERE tokens > 100) AS queries_over_tokens,
      COUNT(*) FILTER (WHERE latency > CAST(0.9 AS DOUBLE)) AS queries_over_seconds, CAST(SUM(tokens) AS BIGINT) AS total_tokens,
      CAST(SUM(CAST(latency AS DECIMAL(18,6))) AS DOUBLE) AS total_seconds FROM log GROUP BY 1)
      SELECT *, {state('total_tokens', 500000)} AS tokens_state, {state('total_seconds', 600)} AS seconds_state FROM s""",
    "latency_distribution": f"""WITH {LOG}, r AS (SELECT approach, latency,
        row_number() OVER (PARTITION BY approach ORDER BY latency, task_id) AS rn,
        COUNT(*) OVER (PARTITION BY approach) AS n FROM log),
      p AS (SELECT unnest([50, 90, 95, 99]) AS percentile)
      SELECT approach, percentile, round(latency, 6) AS latency FROM r JOIN p
        ON rn = (n * percentile + 99) // 100""",
    "error_taxonomy": f"""WITH {LOG} SELECT approach, {KIND} AS error_class, COUNT(*) AS failures FROM log
      WHERE NOT passed GROUP BY 1, 2""",
}
