"""What several operators of this package share: text expressions, stored tables, row boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.session import new_folder, ship_package

#: Fixed: white space of all contracts, as in the character class [\x20\x09-\x0D].
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
ROW = "row"


#: Texts may be long, so few of them go to a Python worker at a time; this bounds its memory and Spark's.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def prepare(spark: SparkSession) -> None:
    """Readies the session for operators with Python in their tasks: ships the package, bounds the batches."""
    ship_package(spark)
    for key, value in ARROW.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    """A column by its plain name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(named(name).cast("string"), F.lit(""))


def without_spaces(text: Column) -> Column:
    return reduce(lambda t, space: F.replace(t, F.lit(space), F.lit("")), SPACES, text)


def row_keys(id_col: str, text_col: str) -> dict[str, Column]:
    """What tells the rows of a table apart, without nulls: rows that agree repeat both id and text."""
    return {
        "id": F.coalesce(named(id_col).cast("string"), F.lit("")),
        "no_id": named(id_col).isNull(),
        "text_hash": F.xxhash64(text_of(text_col)),
    }


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct beside new columns, so that no name can clash; see ``unboxed``."""
    return df.select(F.struct("*").alias(ROW), *[c.alias(n) for n, c in columns.items()])


def unboxed(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")
