"""Rules between sets of words and an outcome, mined from texts in two passes.

First every task mines the word sets that are frequent in its own part; a set frequent in the whole of an outcome is
frequent, by the same share, in at least one part of it, so the union of the parts' sets misses none (Savasere,
Omiecinski and Navathe, 1995). Then all candidates are counted exactly over all texts. A part keeps one bitmap of its
texts per word and outcome: a set is the AND of its words' bitmaps, its count a popcount.

Candidates travel in slices of at most ``SLICE`` sets, one pass per slice, so that what a pass sends has a bound however
many there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.session import materialise, ship_package

#: Texts, and distinct words of texts, that are mined together.
CHUNK_TEXTS = 20_000
CHUNK_WORDS = 4_000_000
#: Texts that are unpacked at a time.
PIECE = 500
SLICE = 200_000
BLOCK = 2048
EXAMPLES = 3


def word_set(text: Column) -> Column:
    """Distinct words (runs of letters, lower-cased) of a text; none of a null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1)))


class Part:
    """Texts of one task as bitmaps: per outcome (failed, passed) one row of bits per word, texts in the order of their ids."""

    def __init__(self, rows: list[tuple], known: Sequence[str] | None = None):
        rows.sort(key=lambda r: (r[0] is None, r[0]))
        split = [[r for r in rows if r[1] == outcome] for outcome in (False, True)]
        self.ids = [[r[0] for r in part] for part in split]
        self.sizes = [len(part) for part in split]
        self.words = sorted({w for r in rows for w in r[2]}) if known is None else list(known)
        place = {w: k for k, w in enumerate(self.words)}
        self.at = []
        for part in split:
            held = [np.array([place[w] for w in r[2] if w in place], np.int64) for r in part]
            texts = np.repeat(np.arange(len(part)), [len(h) for h in held])
            self.at.append(np.column_stack([np.concatenate([np.zeros(0, np.int64), *held]), texts]))

    def counts(self) -> list[np.ndarray]:
        return [np.bincount(at[:, 0], minlength=len(self.words)) for at in self.at]

    def bits(self, kept: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the words numbered in ``kept``."""
        row = np.full(len(self.words), -1)
        row[kept] = np.arange(len(kept))
        maps = []
        for at, size in zip(self.at, self.sizes):
            dense = np.zeros((len(kept), -(-size // 8)), np.uint8)
            rows, texts = row[at[:, 0]], at[:, 1]
            rows, texts = rows[rows >= 0], texts[rows >= 0]
            np.bitwise_or.at(dense, (rows, texts >> 3), (128 >> (texts & 7)).astype(np.uint8))
            maps.append(dense)
        return maps


def popcounts(maps: list[np.ndarray]) -> list[np.ndarray]:
    return [np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in maps]


def often(counts: list[np.ndarray], least: Sequence[float]) -> np.ndarray:
    """Whether a set is frequent in some outcome that the part has texts of."""
    return np.logical_or.reduce([(c >= need) & (c > 0) for c, need in zip(counts, least)])


def frequent_sets(part: Part, share: float, longest: int) -> Iterator[tuple[int, ...]]:
    """The sets of up to ``longest`` words, as word numbers, that hold in a ``share`` of a part's texts of an outcome."""
    least = [share * size for size in part.sizes]
    kept = np.flatnonzero(often(part.counts(), least))

    def grow(prefix: tuple[int, ...], items: np.ndarray, maps: list[np.ndarray]) -> Iterator[tuple[int, ...]]:
        for k, item in enumerate(items):
            longer = (*prefix, int(item))
            yield longer
            if len(longer) < longest and k + 1 < len(items):
                shared = [m[k] & m[k + 1:] for m in maps]
                good = often(popcounts(shared), least)
                if good.any():
                    yield from grow(longer, items[k + 1:][good], [m[good] for m in shared])

    yield from grow((), kept, part.bits(kept))


def _parts(batches: Iterator[pa.RecordBatch], known: Sequence[str] | None = None) -> Iterator[Part]:
    rows, words, one = [], 0, {}
    for piece in (batch.slice(start, PIECE) for batch in batches for start in range(0, batch.num_rows, PIECE)):
        for id_, passed, held in zip(*[piece.column(c).to_pylist() for c in ("id", "passed", "words")]):
            # A word that recurs is held once for all texts.
            rows.append((id_, passed, [one.setdefault(w, w) for w in held]))
            words += len(held)
            if len(rows) >= CHUNK_TEXTS or words >= CHUNK_WORDS:
                yield Part(rows, known)
                rows, words, one = [], 0, {}
    if rows:
        yield Part(rows, known)


def _candidates_with(share: float, longest: int):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = []
            for numbers in frequent_sets(part, share, longest):
                found.append([part.words[k] for k in numbers])
                if len(found) == 10_000:
                    yield pa.record_batch({"words": pa.array(found, pa.list_(pa.string()))})
                    found = []
            yield pa.record_batch({"words": pa.array(found, pa.list_(pa.string()))})

    return candidates


def _counted_with(sent):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = sent.value
        known = sorted({w for s in sets for w in s})
        place = {w: k for k, w in enumerate(known)}
        by_size: dict[int, list[list[str]]] = {}
        for s in sets:
            by_size.setdefault(len(s), []).append(s)
        for part in _parts(batches, known):
            maps = part.bits(np.arange(len(known)))
            for same in by_size.values():
                for start in range(0, len(same), BLOCK):
                    block = same[start: start + BLOCK]
                    at = np.array([[place[w] for w in s] for s in block])
                    yield from _counted_block(block, [np.bitwise_and.reduce(m[at], axis=1) for m in maps], part)

    return counted


def _counted_block(sets: list, maps: list[np.ndarray], part: Part) -> Iterator[pa.RecordBatch]:
    for passed, (rows, counts) in enumerate(zip(maps, popcounts(maps))):
        seen = np.flatnonzero(counts)
        ids = [[part.ids[passed][n] for n in np.flatnonzero(np.unpackbits(rows[k]))[:EXAMPLES]] for k in seen]
        yield pa.record_batch({
            "words": pa.array([sets[k] for k in seen], pa.list_(pa.string())), "passed": pa.array([bool(passed)] * len(seen), pa.bool_()),
            "n": pa.array(counts[seen], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())),
        })


def word_sets(traces: DataFrame, share: float, longest: int = 2) -> tuple[DataFrame, DataFrame, dict[bool, int]]:
    """All sets of up to ``longest`` words that a ``share`` of the failed or of the passed texts holds, counted in both.

    ``traces`` has id (long), text, passed; a null outcome is a failure. Returns (words, failed, passed), the smallest ids
    per set and outcome as (words, passed, id), and the number of texts by outcome.
    """
    ship_package(traces.sparkSession)
    texts = materialise(traces.select("id", F.coalesce("passed", F.lit(False)).alias("passed"), word_set(F.col("text")).alias("words")))
    sizes = {False: 0, True: 0} | {r["passed"]: r["n"] for r in texts.groupBy("passed").agg(F.count("*").alias("n")).collect()}
    # Small parts make many candidates by chance, so the texts meet in as few as their number asks for.
    dealt = texts.coalesce(max(1, -(-sum(sizes.values()) // CHUNK_TEXTS)))
    candidates = materialise(dealt.mapInArrow(_candidates_with(share, longest), "words array<string>").distinct())
    slices = max(1, -(-candidates.count() // SLICE))
    found = None
    for k in range(slices):
        sets = [r["words"] for r in candidates.filter(F.pmod(F.xxhash64("words"), F.lit(slices)) == k).collect()]
        sent = traces.sparkSession.sparkContext.broadcast(sets)
        part = dealt.mapInArrow(_counted_with(sent), "words array<string>, passed boolean, n bigint, ids array<bigint>")
        found = part if found is None else found.unionByName(part)
    found = materialise(found)
    counts = found.groupBy("words").agg(*[
        F.sum(F.when(F.col("passed") == outcome, F.col("n")).otherwise(0)).alias(name)
        for name, outcome in (("failed", False), ("passed", True))
    ])
    return counts, found.select("words", "passed", F.explode("ids").alias("id")), sizes


def mine_rules(
    traces: DataFrame, share: float = 0.05, contrast: float = 2.0, longest: int = 2, outcomes: Sequence[bool] = (False, True)
) -> DataFrame:
    """Rules "a text with these words fails / passes": words, passed, support, share, other_share, confidence, examples.

    ``support`` counts the texts of the outcome with all the words, ``share`` is their part of the outcome, ``other_share``
    that of the other outcome, ``confidence`` the part of the texts with the words that have the outcome, ``examples`` the
    smallest ids. A rule needs ``share`` and ``contrast`` times the other share. Null and empty texts have no words but
    count in their outcome; rows that repeat count each; without rows of an outcome it has no rules.
    """
    counts, ids, sizes = word_sets(traces, share, longest)
    one_of = Window.partitionBy("words", "passed").orderBy("id")
    chosen = (
        ids.withColumn("nth", F.row_number().over(one_of)).filter(F.col("nth") <= EXAMPLES)
        .groupBy("words", "passed").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    )
    sides = []
    for outcome in outcomes:
        own, other = ("passed", "failed") if outcome else ("failed", "passed")
        sides.append(counts.select(
            "words", F.lit(outcome).alias("passed"), F.col(own).alias("support"),
            (F.col(own) / F.lit(max(1, sizes[outcome]))).alias("share"), (F.col(other) / F.lit(max(1, sizes[not outcome]))).alias("other_share"),
            (F.col(own) / (F.col(own) + F.col(other))).alias("confidence"),
        ).filter((F.col("support") >= share * sizes[outcome]) & (F.col("support") > 0) & (F.col("share") >= contrast * F.col("other_share"))))
    rules = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return rules.join(chosen, ["words", "passed"])
