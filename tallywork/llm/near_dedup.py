"""Near-dedup by SimHash and shingle sets: texts link where the Jaccard similarity of their 5-word shingles is 0.8 or more, exactly.

A text similar to another shares at least four fifths of its shingles, so most texts can be ruled out by shingles that no
other text has. First only the shingles of a fixed class, three tenths of all by hash, are counted: a text with more lone
ones among them than a fifth of its set is out. The rest, known to the tasks by a bitmap of fixed size (a wrong bit costs
work, never a pair), have all their shingles counted, and those with too few shared ones go. What stays is small, and
from here on only shared shingles matter: the intersection of two texts holds no others.

SimHash proposes pairs (see ``simhash``: segment-popcount embedding, grid cells, bound and exact distance) twice. Every text
has op4's fingerprint, and the grid join finds all pairs that these link. Texts that may be similar also have 64 bits of the
single words, repeats included, for a changed word then moves fewer bits than with shingles. A large group of near copies
would make a pair of any two, so by these a text only meets the leader of each cell it looks into, the text with the fewest
lone shingles: copies made from one text with changes of their own lie nearer to it than to each other. Proposed pairs are
held to the exact similarity and joined to components: first those with leaders, last all of op4's that still lie apart.

No distance of fingerprints reaches every similar pair, so what still lies in different components is met exactly, by a
prefix-filtered join: with the rarest shingles first, two similar sets of sizes n share one among the first
n - ceil(0.8 n) + 1 of each, and the positions where they meet bound what they share. Each shingle's list first only meets
its leader, and then the pairs of a list that still lie in different components follow, and none is left out.

Equal texts are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import boxed, named, row_keys, store, text_of, unboxed
from tallywork.llm.components import components
from tallywork.llm.simhash import fingerprint, led_links, text_links

SHINGLE_WORDS = 5
#: The least similarity, as a fraction.
PART, WHOLE = 4, 5
#: Of 256 hash classes, how many are counted first.
FIRST = 77
#: Bits of the filter of texts, as a mask.
BITS = (1 << 25) - 1
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the 5-word shingles, sorted; a text of fewer words is one shingle."""
    words = text.encode().translate(_LOWER).split()
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64).view(np.int64)
    hashes = np.array([*map(xxhash.xxh64_intdigest, words)], np.uint64)
    n = len(words) - SHINGLE_WORDS + 1
    mixed = hashes[:n] * _PLACE[0]
    for k in range(1, SHINGLE_WORDS):
        mixed = (mixed ^ mixed >> np.uint64(29)) + hashes[k: k + n] * _PLACE[k]
    return np.unique((mixed ^ mixed >> np.uint64(32)).view(np.int64))


def _spare(n: int) -> int:
    """How many shingles of a set of ``n`` a similar one may lack."""
    return n - -(-n * PART // WHOLE)


def _in_first(hashes: np.ndarray) -> np.ndarray:
    return (hashes & 255) < FIRST


def _first_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the first class by text, once per batch each, and what is known of a text at once (``sure``).

    A shingle that recurs in the batch is shared by all its texts here, so one row of it goes out, without weight. A text
    needs ``need`` shared ones; one that needs none is sure as well, but its shingles go out, for another text may share them.
    A sure row has the text's own number as its hash.
    """
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        parts, needs = [], []
        for text in batch.column("text"):
            whole = shingles(text.as_py())
            parts.append(whole[_in_first(whole)])
            needs.append(max(0, len(parts[-1]) - _spare(len(whole))))
        needs = np.array(needs, np.int32)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        _, first, back, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        known = np.bincount(owner[counts[back] > 1], minlength=len(parts))
        sure = np.flatnonzero((known > 0) | (needs == 0))
        texts = np.concatenate([owner[first], sure])
        yield pa.record_batch({
            "hash": pa.array(np.concatenate([hashes[first], nodes[sure]])), "node": pa.array(nodes[texts]), "need": pa.array(needs[texts]),
            "weight": pa.array(np.concatenate([counts == 1, known[sure]]).astype(np.int32)),
            "sure": pa.array(np.arange(len(texts)) >= len(first)),
        })


def _all_with(sent):
    def everything(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All shingles, and their number, of the texts that the first class does not rule out; a row without hash has the fingerprint."""
        words = sent.value
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            asked = np.flatnonzero(words[(nodes & BITS) >> 6] >> (nodes & 63) & 1)
            texts = [batch.column("text")[i].as_py() for i in asked.tolist()]
            found = [shingles(t) for t in texts]
            sizes = np.array([len(f) for f in found], np.int32)
            yield pa.record_batch({
                "hash": pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)),
                "node": pa.array(np.repeat(nodes[asked], sizes)), "n": pa.array(np.repeat(sizes, sizes)),
                "print": pa.nulls(int(sizes.sum()), pa.int64()),
            })
            yield pa.record_batch({
                "hash": pa.nulls(len(texts), pa.int64()), "node": pa.array(nodes[asked]), "n": pa.array(sizes),
                "print": pa.array([fingerprint(t, 1) for t in texts], pa.int64()),
            })

    return everything


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """The low bits of the nodes as a bitmap of fixed size."""
    bit = F.expr("shiftleft(1L, CAST(node & 63 AS INT))")
    found = nodes.groupBy(F.shiftright(F.col("node").bitwiseAND(F.lit(BITS)), 6).alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
    words = np.zeros((BITS + 1) >> 6, np.int64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return words


def _maybe_similar(texts: DataFrame) -> DataFrame:
    """The nodes that the first class of shingles does not rule out."""
    first = texts.mapInArrow(_first_class, "hash bigint, node bigint, need int, weight int, sure boolean")
    held = first.withColumn("df", F.count("*").over(Window.partitionBy("hash"))).filter("df > 1 OR sure")
    return held.groupBy("node").agg(F.sum("weight").alias("m"), F.max("need").alias("need")).filter("m >= need")


def shared_sets(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, n, shingles of the texts that may be similar to another: their shared shingles as (df, hash), rarest first; and node, print."""
    sent = texts.sparkSession.sparkContext.broadcast(_bitmap(_maybe_similar(texts)))
    every = store(texts.mapInArrow(_all_with(sent), "hash bigint, node bigint, n int, print bigint"), "shingles")
    hashes = every.filter("hash IS NOT NULL").drop("print")
    shared = hashes.groupBy("hash").agg(F.count("*").alias("df")).filter("df > 1")
    sets = hashes.join(shared, "hash").groupBy("node", "n").agg(F.sort_array(F.collect_set(F.struct("df", "hash"))).alias("shingles"))
    sets = store(sets.filter(WHOLE * F.size("shingles") >= PART * F.col("n")), "sets")
    return sets, every.filter("hash IS NULL").select("node", "print").distinct()


def _proposed(sets: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs (a, b) that SimHash proposes, a the leader of a cell, without those whose numbers of shingles rule them out."""
    row = F.struct((F.col("n") - F.size("shingles")).alias("lone"), "node", "n").alias("row")
    met = led_links(sets.join(prints, "node").select("print", row))
    most = F.least(F.col("x.n") - F.col("x.lone"), F.col("y.n") - F.col("y.lone"))
    fits = (PART + WHOLE) * most >= PART * (F.col("x.n") + F.col("y.n"))
    return met.filter(fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _may_match(a: str, b: str) -> Column:
    """Whether two sets that meet first at these positions can share enough; false for no similar pair at all its meetings."""
    left, right = (F.col(f"{s}.n") - F.col(f"{s}.pos") for s in (a, b))
    return (PART + WHOLE) * F.least(left, right) >= PART * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of ``pairs`` (a, b). The set of b meets its few pairs first, then that of a, a leader, all of its own."""
    of = {s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("shingles.hash").alias(f"of_{s}")) for s in ("a", "b")}
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(of["b"], "b").join(of["a"], "a").filter(
        (PART + WHOLE) * shared >= PART * (F.col("n_a") + F.col("n_b"))
    ).select("a", "b")


def _lists(sets: DataFrame) -> DataFrame:
    """hash, node, n, pos, lone of the prefixes; lone shingles come before the shared ones in each."""
    lone = F.col("n") - F.size("shingles")
    prefix = F.col("n") - F.ceil(F.col("n") * PART / WHOLE).cast("int") + 1 - lone
    return sets.select("node", "n", lone.alias("lone"), F.posexplode(F.slice("shingles", F.lit(1), prefix)).alias("at", "shingle")).select(
        F.col("shingle.hash").alias("hash"), "node", "n", (F.col("lone") + F.col("at")).alias("pos"), "lone"
    )


def _with_roots(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """``lists`` with the root of each node in ``roots`` (node, root; other nodes are their own)."""
    return lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` (a, b) whose nodes lie in different components of ``roots`` (node, root; other nodes are their own)."""
    of = {s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")) for s in ("a", "b")}
    return pairs.join(of["a"], "a", "left").join(of["b"], "b", "left").filter(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    ).select("a", "b")


def similar(texts: DataFrame) -> DataFrame:
    """(node, root) of every node of ``texts`` (node, text) that is similar to another; root is the least node it reaches."""
    met = store(text_links(texts), "met")
    sets, prints = shared_sets(texts)
    proposed = store(_proposed(sets, prints), "proposed")
    first = store(_verified(proposed, sets), "linked")
    lists = store(_with_roots(_lists(sets), components(first)), "lists")
    leaders = lists.groupBy("hash").agg(F.min(F.struct("lone", "node", "n", "pos", "root")).alias("x"))
    led = lists.select("hash", F.struct("node", "n", "pos", "root").alias("y")).join(leaders, "hash").filter("x.root != y.root")
    tried = store(led.filter(_may_match("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "tried")
    near = store(first.union(_verified(tried, sets)), "links")
    roots = store(components(near), "roots")
    rooted = _with_roots(lists.drop("root"), roots)
    apart = rooted.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    mixed = store(rooted.join(apart, "hash", "left_semi"), "mixed")
    # Of a pair the one with the smaller set (then node) has its meeting within a ninth of it, for the two together hold twice it at least.
    short = mixed.filter((PART + WHOLE) * (F.col("n") - F.col("pos")) >= 2 * PART * F.col("n"))
    others = short.alias("x").join(
        mixed.alias("y"),
        (F.col("x.hash") == F.col("y.hash")) & (F.struct("x.n", "x.node") < F.struct("y.n", "y.node"))
        & (F.col("x.root") != F.col("y.root")) & _may_match("x", "y"),
    ).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    others = others.union(_apart(met, roots).select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    done = tried.union(proposed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = store(others.join(done, ["a", "b"], "left_anti"), "rest")
    return components(near.union(_verified(rest, sets)))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of one document per component (the smallest id; a null id only without another).

    A null text is empty; texts of fewer than five words are one shingle, so empty ones are all similar. Of rows that
    repeat id and text one stays. A long text costs its shingles once; an empty table gives an empty result.
    """
    texts = docs.select(F.xxhash64(text_of(text_col)).alias("node"), text_of(text_col).alias("text"))
    found = store(similar(texts), "similar")
    rows = docs.select(named(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("node"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    keep = rows.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("best")).select(
        F.coalesce(F.col("best.doc_id").cast("string"), F.lit("")).alias("id"), F.col("best.no_id").alias("no_id"),
        F.col("best.node").alias("text_hash"),
    )
    keys = ["id", "no_id", "text_hash"]
    box = boxed(docs, **row_keys(id_col, text_col))
    # Rows that repeat id and text are of one component, whose one row stays.
    return unboxed(box.join(keep, keys, "left_semi").dropDuplicates(keys))
