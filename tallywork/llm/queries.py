"""The registered query of each operator: production parameters, whole tables, results as digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import bpe as _bpe
from tallywork.llm import collocations as _collocations
from tallywork.llm import exact_dedup as _exact
from tallywork.llm import fill_in_middle as _fim
from tallywork.llm import line_dedup as _lines
from tallywork.llm import mixing as _mixing
from tallywork.llm import pii as _pii
from tallywork.llm import quality_rules as _quality
from tallywork.llm import simhash as _simhash
from tallywork.llm import suffix_array as _suffixes
from tallywork.llm import suffix_tree_lm as _lm
from tallywork.llm import toxicity as _toxicity
from tallywork.llm import warc as _warc
from tallywork.llm.common import prepare, table


def op1_exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    return _exact.exact_dedup(table(spark, path, "documents")).drop("n_chars")


def op2_mixing(spark: SparkSession, path: str) -> DataFrame:
    return _mixing.mix(table(spark, path, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


def op3_toxicity(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, path, "documents")
    return _toxicity.score_documents(docs, _toxicity.train(docs, table(spark, path, "labels")))


def op4_simhash(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    return _simhash.near_duplicates(table(spark, path, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_lm_scoring(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, path, "documents")
    return _lm.score_documents(docs, *_lm.train(docs))


def op6_pii(spark: SparkSession, path: str) -> DataFrame:
    found = _pii.pii_spans(table(spark, path, "documents"))
    base = [k.name for k in _pii.KINDS if k.base]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind))

    return found.select(
        "doc_id",
        *[number(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op7_bpe(spark: SparkSession, path: str, vocabulary: str | None = None) -> DataFrame:
    prepare(spark)
    coded = _bpe.encode_documents(table(spark, path, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_suffix_array(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    return _suffixes.suffix_dedup(table(spark, path, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256"), "n_shared",
    )


def op9_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    return _quality.quality_report(table(spark, path, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    return _lines.line_dedup(table(spark, path, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op11_collocations(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    return _collocations.collocations(table(spark, path, "documents"))


def op12_warc(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    return _warc.round_trip(table(spark, path, "pages")).drop("uri", "payload")


def op13_fill_in_middle(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    made = _fim.transform(table(spark, path, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
        F.sha2(_fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_mixing, op3_toxicity, op4_simhash, op5_lm_scoring, op6_pii, op7_bpe, op8_suffix_array,
        op9_quality_rules, op10_line_dedup, op11_collocations, op12_warc, op13_fill_in_middle,
    )
}
