"""A training corpus from raw documents in stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallywork.llm.bpe import encode_documents
from tallywork.llm.common import prepare, store, table
from tallywork.llm.exact_dedup import drop_exact_copies
from tallywork.llm.mixing import mixed_rows
from tallywork.llm.near_dedup import keep_one_of_each
from tallywork.llm.quality_rules import keep_good
from tallywork.session import drop_scratch, scratch_paths


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """``stage`` after the working tables of the stage before are dropped, for its result is a written table by then.

    A table that ``docs`` itself still reads stays.
    """
    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _LEFT else []
        drop_scratch(spark, [p for p in _LEFT if not any(p.rsplit("/", 1)[-1] in f for f in files)])
        before = set(scratch_paths())
        out = stage(spark, docs, sf_dir)
        _LEFT[:] = [p for p in scratch_paths() if p not in before]
        return out

    return tidied


@_tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words, so they go."""
    prepare(spark)
    return keep_good(docs)


@_tidy
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside; null and empty texts are equal."""
    return drop_exact_copies(docs)


@_tidy
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8 or more); a null text is empty."""
    prepare(spark)
    return keep_one_of_each(docs)


@_tidy
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for; null and empty texts have no size and are not taken."""
    return mixed_rows(docs)


@_tidy
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to; none for a null or empty text."""
    prepare(spark)
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The near-duplicate and encoding stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
