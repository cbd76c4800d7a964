"""Scans and sinks: CSV, Parquet, JSON, JSON-lines task files, parameterised SQL, catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"
#: With open files side by side a task need not sort its rows by partition; beyond that number it does.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

TASK_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "nl", "gold_sql", "checker")])
KPI_TASK_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("id", "kpi_name", "formula_nl")],
    T.StructField("expected_properties", T.ArrayType(T.StringType())),
    T.StructField("gold_measure", T.StringType()),
])


def _existing(read, path: str) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise


def scan_csv(
    spark: SparkSession, path: str, table: str | None = None, schema: T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with header. A declared schema is binding (bad rows fail); without one, types are inferred.

    Values with line breaks need ``multi_line``, at a price: such files cannot be split.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    reader = reader.option("escape", '"').option("multiLine", multi_line)  # quotes in values are doubled
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return as_table(_existing(reader.csv, path), table)


def scan_parquet(
    spark: SparkSession, path: str, table: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return as_table(_existing(reader.parquet, path), table)


def scan_json(
    spark: SparkSession, path: str, table: str | None = None, schema: T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema is not None else reader
    return as_table(_existing(reader.json, path), table)


def scan_tasks_jsonl(
    spark: SparkSession, path: str, schema: T.StructType = TASK_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """Tasks of a JSON-lines file, and the lines that are no JSON objects.

    Blank lines and ``#`` comments belong to neither.
    """
    line = F.trim("value")
    lines = _existing(spark.read.text, path).select(line.alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    marked = schema.add(T.StructField(CORRUPT, T.StringType())) if CORRUPT not in schema.names else schema
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.withColumn("task", F.from_json("line", marked, options))
    broken = F.col("task").isNull() | F.col(f"task.{CORRUPT}").isNotNull()
    tasks = parsed.filter(~broken).select(*[F.col("task")[c].alias(c) for c in schema.names if c != CORRUPT])
    return tasks, parsed.filter(broken).select("line")


def as_table(df: DataFrame, table: str | None) -> DataFrame:
    if table:
        df.createOrReplaceTempView(table)
    return df


def sink_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), even: bool = True) -> None:
    """Overwrites. Partitioned output is rebalanced first, so that files come out even:
    AQE splits hot partition values and merges small ones.

    Without ``even`` nothing moves: every task writes a file per value that it holds, side by side. For few values
    and rows that are spread already.
    """
    if partition_by and even:
        df = df.hint("rebalance", *partition_by)
    conf, before = df.sparkSession.conf, None
    if not even:
        before = conf.get(WRITERS)
        conf.set(WRITERS, "64")
    try:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    finally:
        if before is not None:
            conf.set(WRITERS, before)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def sink_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parameterised_query(spark: SparkSession, sql: str, params: Sequence = ()) -> DataFrame:
    """SQL with positional ``?`` parameters over the registered tables."""
    return spark.sql(sql, args=list(params)) if params else spark.sql(sql)


def catalog_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count and columns per table; one job counts them all."""
    audits = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.lit(len(df.columns)).alias("column_count"), F.lit(", ".join(df.columns)).alias("columns"),
        )
        for name, df in tables.items()
    ]
    audit = audits[0]
    for more in audits[1:]:
        audit = audit.unionByName(more)
    return audit


def registered_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables()}


def table_info(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
