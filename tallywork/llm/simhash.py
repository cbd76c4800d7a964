"""SimHash near-dedup with a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits; its embedding is the vector of their
popcounts. The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so it is a lower bound that may rule pairs out, never the other way round.

Grid range-join: at distance three or less, one half of the vector (16 coordinates) differs by one
step at most. Each fingerprint stands in the grid cell of either half and probes that cell and the
cells one step up; a pair one step apart is met from its lower side. Pairs that share a cell are
held to the lower bound over the whole vector and then to the exact distance.

A popcount of a two-bit segment is kept in unary (00, 01, 11: the segment's bits sorted), so that
the Manhattan distance is the popcount of an exclusive or.

Equal fingerprints are one node; copies of a text are never paired with each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import boxed, named, row_keys, store, text_of, unboxed
from tallywork.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 3
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_EVEN = 0x5555_5555_5555_5555
_HALF = (1 << 32) - 1


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the shingles of ``width`` words; 0 without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    last = (ends[width - 1:] - 1).tolist() or [len(joined)]
    first = [0, *ends[: n - 1].tolist()]
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], SEED) for a, b in zip(first, last)], dtype=np.uint64)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def embedding(print_: Column) -> Column:
    """Segment popcounts in unary, 32 coordinates of two bits."""
    up = F.shiftrightunsigned(print_, 1)
    some, both = print_.bitwiseOR(up).bitwiseAND(F.lit(_EVEN)), print_.bitwiseAND(up).bitwiseAND(F.lit(_EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _half(vector: Column, half: int) -> Column:
    return F.shiftrightunsigned(vector, 32).bitwiseAND(F.lit(_HALF)) if half else vector.bitwiseAND(F.lit(_HALF))


def _cell(half: int, place: Column) -> Column:
    return F.lit(half << 32).bitwiseOR(place)


def _probes(half: int) -> Column:
    """This half's own cell and those one step up in one coordinate (null where it is at its top)."""
    at = _half(F.col("vector"), half)
    up = []
    for i in range(16):
        value = F.shiftrightunsigned(at, 2 * i).bitwiseAND(F.lit(3))
        step = F.when(value == 0, F.lit(1)).when(value == 1, F.lit(2)).cast("long")
        up.append(F.struct(_cell(half, at.bitwiseOR(F.shiftleft(step, 2 * i))).alias("cell"), F.lit(True).alias("up")))
    return F.array(F.struct(_cell(half, at).alias("cell"), F.lit(False).alias("up")), *up)


def _long(column: Column) -> Column:
    return column.cast("long")


def _homes(placed: DataFrame, **columns: Column) -> DataFrame:
    """The two cells that each vector of ``placed`` stands in, with other columns."""
    cells = F.explode(F.array(*[_long(_cell(h, _half(F.col("vector"), h))) for h in (0, 1)])).alias("cell")
    return placed.select(cells, *[c.alias(n) for n, c in columns.items()])


def _probing(placed: DataFrame, **columns: Column) -> DataFrame:
    """The cells that each vector of ``placed`` looks into (cell, up), with other columns."""
    kept = [c.alias(n) for n, c in columns.items()]
    return placed.select(*kept, F.explode(F.concat(_probes(0), _probes(1))).alias("probe")).select(
        *columns, F.col("probe.cell").alias("cell"), F.col("probe.up").alias("up")
    ).filter("cell is not null")


def _within(a: Column, b: Column) -> Column:
    """The lower bound over the whole vector, then the exact distance."""
    apart = embedding(a).bitwiseXOR(embedding(b))
    return (F.bit_count(apart) <= MAX_DISTANCE) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_DISTANCE)


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints in ``prints`` (print, distinct) within ``MAX_DISTANCE`` bits."""
    placed = prints.select("print", embedding(F.col("print")).alias("vector"))
    homes, probes = _homes(placed, b=F.col("print")), _probing(placed, a=F.col("print"))
    apart = embedding(F.col("a")).bitwiseXOR(embedding(F.col("b")))
    # A pair that meets in the first half is not reported again by the second.
    again = (F.shiftrightunsigned(F.col("p.cell"), 32) == 1) & (F.bit_count(_half(apart, 0)) <= 1)
    return probes.alias("p").join(
        homes.alias("h"),
        (F.col("p.cell") == F.col("h.cell")) & (F.col("up") | (F.col("a") < F.col("b"))) & _within(F.col("a"), F.col("b")) & ~again,
    ).select("a", "b")


def text_links(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of ``texts`` (node, text) that fingerprints link, those of equal ones included.

    Texts of one fingerprint are a class, and its least node stands for it: it meets each member, and the representative of
    every class within ``MAX_DISTANCE`` bits. So the pairs connect all that links of any two texts would, and no class squares.
    """
    rows = store(texts.select("node", fingerprints("text").alias("print")).distinct(), "fingerprints")
    classes = store(rows.groupBy("print").agg(F.min("node").alias("least")), "prints")
    of = {s: classes.select(F.col("print").alias(s), F.col("least").alias(f"least_{s}")) for s in ("a", "b")}
    across = links(classes.select("print")).join(of["a"], "a").join(of["b"], "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    within = rows.join(classes, "print").filter("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return across.union(within)


def led_links(prints: DataFrame) -> DataFrame:
    """Pairs (x, y) of rows of ``prints`` (print, row: a struct, least first) within ``MAX_DISTANCE`` bits, where x is the least row of a cell.

    For a use that only needs components: a row meets one other in each cell it looks into, however many stand there.
    Repeated fingerprints meet too. What the leaders leave apart is not found.
    """
    placed = prints.select("print", "row", embedding(F.col("print")).alias("vector"))
    leaders = _homes(placed, x=F.struct("row", "print")).groupBy("cell").agg(F.min("x").alias("x"))
    probes = _probing(placed, y=F.struct("row", "print"))
    return probes.join(leaders, "cell").filter((F.col("x.row") != F.col("y.row")) & _within(F.col("x.print"), F.col("y.print"))).select(
        F.col("x.row").alias("x"), F.col("y.row").alias("y")
    ).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, print (signed), text_hash, first.

    Documents link at ``MAX_DISTANCE`` differing bits or fewer; component_id is the smallest id
    reachable. Null and empty texts have fingerprint zero and link like any other. A null id is never
    the smallest unless a component has no other. ``first`` marks one row per component: the smallest
    id, of repeated ids one. Only two columns are read.
    """
    rows = store(
        docs.select(
            named(id_col).alias("doc_id"), fingerprints(text_of(text_col)).alias("print"),
            F.xxhash64(text_of(text_col)).alias("text_hash"), F.monotonically_increasing_id().alias("place"),
        ),
        "fingerprints",
    )
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place")
    prints = store(rows.groupBy("print").agg(F.min(order).alias("least")), "prints")
    found = components(links(prints.select("print")))
    rooted = prints.join(found, prints["print"] == found["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    named_roots = rooted.groupBy("root").agg(F.min("least").alias("best"))
    classes = store(rooted.join(named_roots, "root").select("print", "best"), "classes")
    return rows.join(classes, "print").select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"),
        "print",
        "text_hash",
        (F.col("place") == F.col("best.place")).alias("first"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of one document per component (the smallest id)."""
    keys = ["id", "no_id", "text_hash"]
    keep = near_duplicates(docs, id_col, text_col).filter("first").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_hash"
    )
    box = boxed(docs, **row_keys(id_col, text_col))
    # Rows that repeat id and text are of one component, whose one row stays.
    return unboxed(box.join(keep, keys, "left_semi").dropDuplicates(keys))
