"""How many texts mention each name of a dictionary, in one walk per text whatever the number of names.

The names become an Aho–Corasick automaton, which reports every name that ends at a place while it reads a text once. A
dictionary of any size is cut into slices of at most ``SLICE_BYTES``, measured first: a slice is what is sent to the tasks
and one pass over the texts serves it. Tasks count per batch, so a name in every text moves one row per batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.session import ship_package

SLICE_BYTES = 8 << 20
#: Fixed: what counts as part of a word.
WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def automaton(names: list[str]):
    import ahocorasick  # only in tasks

    built = ahocorasick.Automaton()
    for name in names:
        built.add_word(name, name)
    built.make_automaton()
    return built


def mentioned(built, text: str) -> set[str]:
    """The names that stand in ``text`` as whole words: next to a word character of the name lies none of the text."""
    found: set[str] = set()
    if not len(built):
        return found
    for last, name in built.iter(text):
        if name in found:
            continue
        before, after = last - len(name), last + 1
        inside = before >= 0 and text[before] in WORD and name[0] in WORD
        inside = inside or after < len(text) and text[after] in WORD and name[-1] in WORD
        if not inside:
            found.add(name)
    return found


def _counted_with(sent):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton(sent.value)
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                seen.update(mentioned(built, text))
            yield pa.record_batch({"name": pa.array(list(seen), pa.string()), "texts": pa.array(list(seen.values()), pa.int64())})

    return counted


def _folded(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def mentions(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """name (lower-cased, each once), texts: how many rows of ``texts`` mention it, 0 included.

    Case does not matter. Null and empty names are left out, null texts mention nothing, rows that repeat count each.
    """
    spark = texts.sparkSession
    ship_package(spark)
    known = names.select(_folded(F.col(name)).alias("name")).filter("name != ''").distinct()
    size = known.agg(F.sum(F.octet_length("name") + 64)).first()[0] or 0
    slices = -(-size // SLICE_BYTES)
    read = texts.select(_folded(F.col(text)).alias("text")).filter("text != ''")
    result = known.select("name", F.lit(0).cast("long").alias("texts"))
    for k in range(slices):
        part = [r["name"] for r in known.filter(F.pmod(F.xxhash64("name"), F.lit(slices)) == k).toLocalIterator()]
        sent = spark.sparkContext.broadcast(part)
        result = result.unionByName(read.mapInArrow(_counted_with(sent), "name string, texts bigint"))
    return result.groupBy("name").agg(F.sum("texts").alias("texts"))
