"""Line dedup by overlapping windows of three lines.

Lines are compared without white space at their ends; blank lines belong to no window. Every three
consecutive lines of a document are hashed (128 bits). A window that occurs again anywhere later, by
id and position, is repeated, and a line covered by a repeated window goes; blank lines stay.
Counting windows is a partial aggregation; the join back is split by Spark where a window is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import named, row_keys, text_of

WINDOW = 3
ENDS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    """Lines that hold a word, as structs of the bare line and its number."""
    numbered = F.transform(
        F.split(text, "\n"), lambda line, i: F.struct(F.btrim(line, F.lit(ENDS)).alias("line"), i.alias("at"))
    )
    return F.filter(numbered, lambda line: line["line"] != "")


def _windows(lines: Column) -> Column:
    last = F.size(lines) - WINDOW
    hashed = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            F.unhex(F.md5(F.concat_ws("\n", *[F.get(lines, i + k)["line"] for k in range(WINDOW)]))).alias("hash"),
            i.alias("start"),
        ),
    )
    return F.when(last >= 0, hashed)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, no_id, text_hash, starts): per document the starts of windows that occurred before."""
    keys = ["id", "no_id", "text_hash"]
    split = docs.select(
        named(id_col).alias("doc_id"), *[c.alias(n) for n, c in row_keys(id_col, text_col).items()],
        _lines(text_of(text_col)).alias("lines"),
    )
    windows = split.select("doc_id", *keys, F.explode(_windows(F.col("lines"))).alias("w")).select(
        "w.hash", F.struct("no_id", "doc_id", "text_hash", "w.start").alias("place"), "id",
    )
    first = windows.groupBy("hash").agg(
        F.min("place").alias("first"), F.max("place").alias("last")
    ).filter("first < last").select("hash", "first")
    later = windows.join(first, "hash").filter("place > first")
    return later.select("id", "place.no_id", "place.text_hash", "place.start").groupBy(*keys).agg(
        F.collect_set("start").alias("starts")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines (with a word), n_removed, kept_text.

    A null text is empty and gives an empty text. Documents of fewer than three lines lose nothing. Rows that repeat
    id and text count as one document. A null id comes last in the order. Other columns are not read.
    """
    keys = ["id", "no_id", "text_hash"]
    rows = docs.select(
        named(id_col).alias("doc_id"), *[c.alias(n) for n, c in row_keys(id_col, text_col).items()],
        text_of(text_col).alias("text"),
    )
    joined = rows.join(repeated_windows(docs, id_col, text_col), keys, "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.array(*[s + k for k in range(WINDOW)]))))
    lines = joined.select(
        "doc_id", "text", F.split("text", "\n").alias("raw"), _lines(F.col("text")).alias("lines"), covered.alias("covered")
    )
    gone = F.transform("covered", lambda i: F.get("lines", i)["at"])
    # A difference of two sets of positions, so that long texts cost linear time.
    stay = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("raw", i)), "\n")
    return lines.select("doc_id", "text", "raw", F.size("lines").cast("long").alias("n_lines"), gone.alias("gone")).select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
