"""Data-quality checks."""

from oracle.common import dbl

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id",
    "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
}
FOREIGN = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]


def not_null(source: str, table: str, column: str, threshold: float, cte: str = "") -> str:
    return f"""SELECT 'not_null_{table}.{column}' AS name, share >= {threshold} AS passed,
      printf('{column}: %.1f%% non-null (threshold: {threshold * 100:.1f}%%)', share * 100) AS message,
      CAST(total - filled AS DOUBLE) AS null_count, CAST(total AS DOUBLE) AS total, share AS non_null_pct
      FROM (SELECT COUNT(*) AS total, COUNT({column}) AS filled,
        coalesce({dbl(f'COUNT({column})')} / NULLIF(COUNT(*), 0), 0) AS share FROM {source})"""


def unique(table: str, column: str) -> str:
    return f"""SELECT 'unique_{table}.{column}' AS name, total = u AS passed,
      '{column}: ' || u || ' unique of ' || total || ' total' AS message, CAST(total AS DOUBLE) AS total,
      CAST(u AS DOUBLE) AS "unique", CAST(total - u AS DOUBLE) AS duplicates
      FROM (SELECT COUNT(*) AS total, COUNT(DISTINCT {column}) AS u FROM {table})"""


def in_range(table: str, column: str, condition: str, bounds: str) -> str:
    return f"""SELECT 'range_{table}.{column}' AS name, inside = total AS passed,
      '{column}: ' || inside || '/' || total || ' in range {bounds}' AS message, CAST(inside AS DOUBLE) AS in_range,
      CAST(total AS DOUBLE) AS total, lo AS actual_min, hi AS actual_max
      FROM (SELECT COUNT({column}) AS total, COUNT(*) FILTER (WHERE {condition}) AS inside,
        MIN({column}) AS lo, MAX({column}) AS hi FROM {table})"""


def foreign(table: str, column: str, ref: str, ref_column: str, label: str | None = None) -> str:
    return f"""SELECT 'fk_{table}.{column}' AS name, n = 0 AS passed,
      '{column} → {ref}.{label or ref_column}: ' || n || ' orphaned rows' AS message, CAST(n AS DOUBLE) AS orphaned_count
      FROM (SELECT COUNT(*) AS n FROM {table} t WHERE t.{column} IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM {ref} r WHERE r.{ref_column} = t.{column}))"""


SUITE = " UNION ALL ".join(
    f"SELECT name, passed, message FROM ({part})"
    for part in [not_null(t, t, c, 1.0) for t, c in KEYS.items()]
    + [unique(t, c) for t, c in KEYS.items()]
    + [foreign(*f) for f in FOREIGN]
)
LABELLED = "(SELECT d.doc_id, text, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"

SQL = {
    "dq_not_null": " UNION ALL ".join([
        not_null("lineitem", "lineitem", "l_orderkey", 1.0), not_null("lineitem", "lineitem", "l_shipdate", 1.0),
        not_null("lineitem", "lineitem", "l_quantity", 0.95)]),
    "dq_unique": unique("orders", "o_orderkey") + " UNION ALL " + unique("lineitem", "l_orderkey"),
    "dq_range": " UNION ALL ".join([
        in_range("lineitem", "l_discount", "l_discount >= 0 AND l_discount <= CAST(0.05 AS DOUBLE)", "[0, 0.05]"),
        in_range("lineitem", "l_tax", "l_tax >= 0 AND l_tax <= 1", "[0, 1]"),
        in_range("lineitem", "l_quantity", "l_quantity >= 1", "[1, None]")]),
    "dq_foreign_key": " UNION ALL ".join([
        foreign("lineitem", "l_orderkey", "orders", "o_orderkey"),
        foreign("lineitem", "l_partkey", "part", "p_partkey"),
        foreign("orders", "o_orderkey", "lineitem", "l_orderkey", "filled_orderkey")]),
    "dq_suite_from_schema": SUITE,
    "dq_summary": f"""SELECT COUNT(*) AS total_tests, COUNT(*) FILTER (WHERE passed) AS passed,
      COUNT(*) FILTER (WHERE NOT passed) AS failed,
      CAST(COUNT(*) FILTER (WHERE passed) AS DOUBLE) / COUNT(*) AS pass_rate FROM ({SUITE})""",
    "coverage_check": " UNION ALL ".join(
        f"SELECT name, passed, message FROM ({not_null(LABELLED, 'labelled', c, 0.9)})"
        for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"))
    + f""" UNION ALL SELECT 'row_limit_labelled', COUNT(*) <= 1000000, COUNT(*) || ' rows (limit: 1000000)'
      FROM {LABELLED}""",
}
