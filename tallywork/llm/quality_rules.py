"""Quality rules whose cut-offs come from the data: mergeable quantile sketches per language and source.

A sketch is a histogram over logarithmic buckets: a value v lies in bucket ceil(log_g v), zero in
a bucket of its own. Sketches merge by adding counts, so the result does not depend on the order
of merging, a hot source is summed on the map side, and a quantile is within half a bucket
(``GROWTH`` - 1) of the exact one. Documents that fail the base rules stay out of the sketches.

A document is rejected if one of its measures lies above its group's fence, q80 + ``SPREAD`` * the group's spread. The
spread is q80 - q50; where a group hardly varies it is what the least step of the numerator makes in a text of median
length, which the sketch of the denominators gives, so no fence is a constant. A fifth of junk does not move a fence. The
fences of a source, its language and all documents are blended by their numbers of documents, the wider one counting as
``PRIOR`` documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import ROW, boxed, named, store, text_of, unboxed

GROWTH = 1.02
SPREAD = 8.0
PRIOR = 100
ZERO_BUCKET = -1_000_000
#: Measures: numerator, denominator and the least step of the numerator (a window of three words that occurs twice).
MEASURES = {
    "word_length": ("word_chars", "n_words", 1),
    "symbols": ("n_symbols", "n_words", 1),
    "repeats": ("n_repeat_words", "n_words", 6),
    "dup_lines": ("n_dup_lines", "n_lines", 1),
    "capitals": ("n_capitals", "word_chars", 1),
}
DENOMINATORS = ("n_words", "n_lines", "word_chars")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 1
_KIND[list(b"#*$%&|<>")] = 2
_WHITE = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift: n - 2 + shift] |= again
    return int(covered.sum())


def text_features(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()  # on exactly the six white-space bytes
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=3)
    lines = [line for line in text.split("\n") if line.strip(_WHITE)]
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    return (
        len(words), len(text) - int(kinds[1]), int(kinds[2]), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), capitals,
    )


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in FEATURES]))
def features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_features(t) for t in texts], columns=list(FEATURES), dtype="int64")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measure(name: str):
    top, bottom, _ = MEASURES[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def bucket(value):
    return F.when(value <= 0, F.lit(ZERO_BUCKET)).otherwise(F.ceil(F.log(value) / F.lit(math.log(GROWTH))).cast("int"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable sketch per group and measure or denominator."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in (*MEASURES, *DENOMINATORS)])
    return (
        measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("at"))
        .groupBy("lang", "source", "at.measure", "at.bucket").agg(F.count("*").alias("n"))
    )


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, size, fence) from each group's merged sketches; a sketch has a bounded number of buckets."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy(*keys, "measure").orderBy("bucket")
    counted = merged.select(
        *keys, "measure", "bucket",
        F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(Window.partitionBy(*keys, "measure")).alias("size"),
    )
    value = F.when(F.col("bucket") == ZERO_BUCKET, F.lit(0.0)).otherwise(
        2 * F.pow(F.lit(GROWTH), F.col("bucket").cast("double")) / (GROWTH + 1)
    )

    def quantile(name: str, q: float):
        return F.min(F.when((F.col("measure") == name) & (F.col("upto") >= F.ceil(q * F.col("size"))), value))

    wide = counted.groupBy(*keys).agg(
        F.max("size").alias("size"), *[quantile(d, 0.5).alias(f"of_{d}") for d in DENOMINATORS],
        *[quantile(m, q).alias(f"{m}_{q}") for m in MEASURES for q in (0.5, 0.8)],
    )
    rows = []
    for m, (_, bottom, step) in MEASURES.items():
        middle, high = F.col(f"`{m}_0.5`"), F.col(f"`{m}_0.8`")
        spread = F.greatest(high - middle, F.lit(float(step)) / F.col(f"of_{bottom}"))
        rows.append(F.struct(F.lit(m).alias("measure"), (high + SPREAD * spread).alias("fence")))
    return wide.select(*keys, "size", F.explode(F.array(*rows)).alias("at")).select(*keys, "at.measure", "size", "at.fence")


def _blend(fence, size, wider):
    return (size * fence + PRIOR * wider) / (size + PRIOR)


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): a fence for each measure, blended with those of the language and of all documents."""
    own, by_lang = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"])
    every = _fences(sketch, []).select("measure", F.col("fence").alias("general"))
    wider = by_lang.join(every, "measure").select(
        F.col("lang").alias("of_lang"), F.col("measure").alias("of"), _blend(F.col("fence"), F.col("size"), F.col("general")).alias("wider")
    )
    chosen = own.join(wider, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("measure") == F.col("of"))).select(
        "lang", "source", "measure", _blend(F.col("fence"), F.col("size"), F.col("wider")).alias("fence")
    )
    return chosen.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"max_{m}") for m in MEASURES]
    )


def _judge(measured: DataFrame) -> DataFrame:
    """``measured`` plus ``kept``. The fences are stored first, so that Spark sees how small they are."""
    limits = store(fences(sketches(measured)), "fences").select(
        F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[f"max_{m}" for m in MEASURES]
    )
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    within = F.lit(True)
    for m in MEASURES:
        within &= F.col(m) <= F.col(f"max_{m}")
    return measured.join(limits, same, "left").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True))
    )


def _measured(df: DataFrame) -> DataFrame:
    flat = df.withColumn("f", features("text")).select(
        *[c for c in df.columns if c != "text"], "f.*"
    )
    return flat.withColumn("base_failed", base_failed()).withColumns({m: measure(m) for m in MEASURES})


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, base_failed, the measures, their fences and ``kept``.

    A null text has no words (and fails the base rules); a null language or source is a group of
    its own. Repeated rows count as often as they occur, a long text is read whole, and an empty table gives an empty result. Other columns are not read.
    """
    picked = docs.select(
        named(id_col).alias("doc_id"), named("lang").alias("lang"), named("source").alias("source"),
        text_of(text_col).alias("text"),
    )
    return _judge(store(_measured(picked), "measures"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; null and empty texts fail the base rules. Texts are stored once, not shuffled."""
    box = boxed(docs, lang=named("lang"), source=named("source"), text=text_of(text_col))
    return unboxed(_judge(store(_measured(box), "measured_rows")).filter("kept").select(ROW))
