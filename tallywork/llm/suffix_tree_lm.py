"""LM scoring with a probabilistic suffix tree.

Symbols are the bytes of a text's words (A-Z lower-cased), one space after each word, and an end mark. Spark
counts every context of up to ``DEPTH`` bytes with its next symbol over all training documents. A context is
kept if it makes up at least ``LEAST_SHARE`` of all positions and its next-symbol distribution
diverges from that of its next shorter suffix by at least ``LEAST_GAIN`` nats a symbol of the corpus (its
share times the Kullback-Leibler divergence), beyond the one nat that chance gives each of its symbols. Both
tests are relative, so they act alike at every size, and at most 1 / LEAST_SHARE contexts of each length can be kept: the size of the model is bounded.

Distributions are smoothed towards the suffix's (``WEIGHT`` pseudo-counts), the empty context's
towards the uniform one, so every text has a probability. For scoring, the kept contexts become an automaton
over their beginnings, whose states know the longest kept suffix of what was read; the state after
a symbol depends on the last ``DEPTH`` symbols only, so long texts are cut into pieces that are walked
side by side, each started that many symbols earlier.

A word's probability is the mean of the tree's for its letters and of its smoothed count, the base: the tree knows
how words are made, the count which words are there.

The base score needs a count for every word. Words are told apart by 64-bit hashes. Those that make up at least
``HEAVY_SHARE`` of the training words are broadcast, at most 1 / HEAVY_SHARE of them; all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import named, store, text_of

DEPTH = 6
LEAST_SHARE = 5e-6
LEAST_GAIN = 5e-7
WEIGHT = 15.0
HEAVY_SHARE = 5e-7
FOLDS, HELD_OUT = 7, 2
LOG2_10, HALF = float(np.log2(10)), float(np.log10(2))
BLOCK = 2_000_000
PIECE = 256
BUFFER = 3_000_000
END, SPACE = 10, 32
#: Set in the keys of words; the keys of contexts leave it free (DEPTH + 1 bytes, at most seven).
WORD_BIT = np.int64(-(2**63))

_LOWER = bytearray(range(256))
_LOWER[65:91] = range(97, 123)
for _white in (32, *range(9, 14)):
    _LOWER[_white] = SPACE
_LOWER[0] = 13  # zero stands for "before the text"; no stream holds a 13, since it is white space
_LOWER = bytes(_LOWER)
_RANDOM = np.random.default_rng(20_240_229)
_LETTER = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def symbols(texts: list[bytes]) -> np.ndarray:
    """All texts as one stream: an end mark, then each text's words with a space after each, and its end mark."""
    x = np.frombuffer(b"\n" + b"".join(t.translate(_LOWER) + b" \n" for t in texts), np.uint8)
    drop = np.zeros(len(x), bool)
    drop[1:] = (x[1:] == SPACE) & ((x[:-1] == SPACE) | (x[:-1] == END))
    return x[~drop]


def word_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, end marks included, and where it starts. Equal tokens, equal hashes."""
    gap = x == SPACE
    first = np.zeros(len(x), bool)
    first[1:] = ~gap[1:] & (gap[:-1] | (x[:-1] == END))
    starts = np.flatnonzero(first)
    at = np.zeros(len(x), np.int64)
    at[starts] = starts
    offset = np.arange(len(x)) - np.maximum.accumulate(at)
    # A word longer than the table starts it again, one more round of the random numbers turned by the round.
    value = _LETTER[x] * (_PLACE[offset % 4096] + np.uint64(2) * (offset // 4096).astype(np.uint64))
    value[gap] = 0
    return (np.add.reduceat(value, starts) if len(starts) else value[:0]).view(np.int64) | WORD_BIT, starts


def contexts(x: np.ndarray) -> np.ndarray:
    """For each symbol after the first mark: itself in the lowest byte, the ``DEPTH`` before it above, zeros before the text."""
    where = np.arange(len(x))
    mark = np.zeros(len(x), np.int64)
    mark[1:] = np.maximum.accumulate(np.where(x == END, where, 0))[:-1]
    offset, key = where - mark, x.astype(np.int64)
    for k in range(1, DEPTH + 1):
        before = np.zeros(len(x), np.int64)
        before[k:] = x[:-k]
        before[offset < k] = 0
        key |= before << (8 * k)
    return key[1:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose texts (the column ``text``) hold about ``BLOCK`` bytes."""
    for batch in batches:
        sizes = np.cumsum([len(t) for t in (s.as_py() for s in batch.column("text"))] or [0])
        start = 0
        while start < batch.num_rows:
            spent = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, spent + BLOCK)))
            part = batch.slice(start, stop - start)
            yield part, [s.as_py().encode() for s in part.column("text")]
            start = stop


class _Sums:
    """Counts per key, merged when over ``BUFFER`` and sent on when that does not help: memory is bounded."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        found, counts = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.counts.append(counts)
        self.size += len(found)

    def merge(self) -> None:
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(where, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.keys, self.counts, self.size = [keys], [counts], len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            self.merge()
            for at in range(0, self.size, 500_000):
                keys, counts = self.keys[0][at: at + 500_000], self.counts[0][at: at + 500_000]
                yield pa.record_batch({"key": pa.array(keys), "n": pa.array(counts)})
        self.keys, self.counts, self.size = [], [], 0


def count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, followed = _Sums(), _Sums()
    for _, texts in _blocks(batches):
        x = symbols(texts)
        words.add(word_hashes(x)[0])
        followed.add(contexts(x))
        for sums in (words, followed):
            if sums.size > BUFFER:
                sums.merge()
                if sums.size > BUFFER * 3 // 4:
                    yield from sums.rows()
    yield from words.rows()
    yield from followed.rows()


@dataclass
class Model:
    """Automaton and distributions; ``column`` maps a byte to its column in both tables."""

    column: np.ndarray
    follow: np.ndarray
    chosen: np.ndarray
    logs: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    n: int
    norm: float

    def walk(self, x: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol of a stream after its first mark."""
        width, total = self.logs.shape[1], len(x) - 1
        pieces = max(1, -(-total // PIECE))
        columns = np.zeros(DEPTH + pieces * PIECE + 1, self.column.dtype)
        columns[DEPTH: DEPTH + len(x)] = self.column[x]
        # Piece p predicts symbols p * PIECE + 1 on; its walk begins DEPTH symbols earlier.
        starts = np.arange(pieces) * PIECE + 1
        state, out = np.zeros(pieces, np.int32), np.empty((PIECE, pieces), np.float32)
        follow, logs = self.follow.ravel(), self.logs.ravel()
        for k in range(DEPTH):
            state = follow[state * width + columns[starts + k]]
            if k < DEPTH - 1:
                state[0] = 0  # nothing comes before the first mark
        for k in range(PIECE):
            symbol = columns[np.minimum(starts + DEPTH + k, len(columns) - 1)]
            out[k] = logs[self.chosen[state] * width + symbol]
            state = follow[state * width + symbol]
        return out.T.ravel()[:total]


def build(rows: np.ndarray, totals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the automaton from kept contexts: rows of (depth, context, symbol, n), depth 0 included."""
    seen = np.unique(rows[rows[:, 0] == 0, 2])
    column = np.full(256, len(seen), np.int64)  # the last column: any byte never seen
    column[seen] = np.arange(len(seen))
    width = len(seen) + 1
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])]) if len(rows) else np.zeros(0, int)
    names, dists = {}, []
    for a, b in zip(first, [*first[1:], len(rows)]):
        depth, context = int(rows[a, 0]), int(rows[a, 1])
        name = context.to_bytes(depth, "big")  # the latest symbol is the lowest byte
        n = np.zeros(width)
        n[column[rows[a:b, 2]]] = rows[a:b, 3]
        if depth == 0:
            p = (n + 1) / (totals + 256)
        else:
            suffix = next(name[k:] for k in range(1, depth + 1) if name[k:] in names)
            p = (n + WEIGHT * dists[names[suffix]]) / (n.sum() + WEIGHT)
        names[name] = len(dists)
        dists.append(p)
    if not dists:
        names[b""], dists = 0, [np.full(width, 1 / 256)]
    prefixes = sorted({name[:k] for name in names for k in range(len(name) + 1)}, key=lambda s: (len(s), s))
    number = {s: i for i, s in enumerate(prefixes)}
    follow = np.zeros((len(prefixes), width), np.int32)
    chosen = np.zeros(len(prefixes), np.int64)
    fail = np.zeros(len(prefixes), np.int64)
    children: dict[bytes, list[bytes]] = {}
    for s in prefixes[1:]:
        children.setdefault(s[:-1], []).append(s)
    for s, i in number.items():  # shorter ones first: a state's fallback is complete before the state
        chosen[i] = names.get(s, chosen[fail[i]])
        if i:
            follow[i] = follow[fail[i]]
        for child in children.get(s, ()):
            at = column[child[-1]]
            fail[number[child]] = follow[i, at]  # where the fallback goes with this symbol
            follow[i, at] = number[child]
    return column, follow, chosen, np.log10(np.array(dists)).astype(np.float32)


def _levels(followed: DataFrame, total: int) -> list[DataFrame]:
    """For each depth the frequent contexts: (context, symbol, n, total), counted from the next longer ones."""
    levels, rows = [], followed.select("key", "n")
    for depth in range(DEPTH, -1, -1):
        mask = (1 << (8 * (depth + 1))) - 1
        rows = store(rows.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n")), "level")
        pairs = rows.select(F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).alias("symbol"), "n")
        if depth:  # one that begins before the text is the same as a shorter one
            pairs = pairs.filter(F.shiftright("context", 8 * (depth - 1)) != 0)
        sums = pairs.groupBy("context").agg(F.sum("n").alias("total")).filter(F.col("total") >= max(1, LEAST_SHARE * total))
        levels.append(pairs.join(sums, "context"))
    return levels[::-1]


def kept_contexts(followed: DataFrame, total: int) -> np.ndarray:
    """Rows (depth, context, symbol, n) of the contexts that pass the divergence test; a bounded number."""
    levels = _levels(followed, total)
    out = [levels[0].select(F.lit(0).alias("depth"), "context", "symbol", "n")]
    for depth in range(1, DEPTH + 1):
        mask = (1 << (8 * (depth - 1))) - 1
        shorter = levels[depth - 1].select(
            F.col("context").alias("suffix"), "symbol", F.col("n").alias("m"), F.col("total").alias("all")
        )
        own = levels[depth].withColumn("suffix", F.col("context").bitwiseAND(F.lit(mask)))
        gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("m") / F.col("all"))))
        passed = own.join(shorter, ["suffix", "symbol"]).groupBy("context").agg(
            (gain - F.count("*")).alias("gain")  # one nat for each number that the context adds
        ).filter(F.col("gain") >= LEAST_GAIN * total)
        out.append(levels[depth].join(passed.select("context"), "context", "left_semi").select(
            F.lit(depth).alias("depth"), "context", "symbol", "n"
        ))
    parts = [df.toArrow() for df in out]
    return np.concatenate([np.stack([t.column(c).to_numpy().astype(np.int64) for c in t.column_names], axis=1) for t in parts])


def is_held_out(id_col):
    """Whether a row is kept from training; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the counts (word, n) of the words too rare to be in it."""
    texts = docs.filter(~is_held_out(named(id_col))).select(text_of(text_col).alias("text"))
    counted = store(
        texts.mapInArrow(count_partition, "key bigint, n bigint")
        .groupBy("key").agg(F.sum("n").alias("n")),
        "counts",
    )
    words, followed = counted.filter(F.col("key") < 0), counted.filter(F.col("key") >= 0)
    n, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = followed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = words.filter(F.col("n") >= max(1.0, HEAVY_SHARE * n)).select("key", "n").toArrow().sort_by("key")
    column, follow, chosen, logs = build(kept_contexts(followed, total), total)
    model = Model(
        column, follow, chosen, logs, heavy.column("key").to_numpy(), heavy.column("n").to_numpy(),
        n, float(np.log10(n + distinct + 1)),
    )
    rare = words.filter(F.col("n") < max(1.0, HEAVY_SHARE * n)).select(F.col("key").alias("word"), "n")
    return model, rare


SCORED = "place bigint, n_tokens bigint, n_known bigint, heavy double, score double, rare array<bigint>, spelled array<float>"


def _score_with(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        logs = np.log10(model.counts + 1.0)
        for part, texts in _blocks(batches):
            x = symbols(texts)
            marks = np.flatnonzero(x == END)
            hashes, starts = word_hashes(x)
            spelled = np.add.reduceat(model.walk(x), starts - 1, dtype=np.float64)  # with the space after the word
            text = np.searchsorted(marks, starts, side="left") - 1
            tokens = np.bincount(text, minlength=len(texts))
            at = np.searchsorted(model.words, hashes)
            at[at == len(model.words)] = 0
            found = model.words[at] == hashes if len(model.words) else np.zeros(len(hashes), bool)
            base = logs[at[found]]
            mixed = np.logaddexp2((base - model.norm) * LOG2_10, spelled[found] * LOG2_10) / LOG2_10 - HALF
            rare = np.bincount(text[~found], minlength=len(texts))
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "place": part.column("place"),
                "n_tokens": pa.array(tokens),
                "n_known": pa.array(np.bincount(text[found], minlength=len(texts))),
                "heavy": pa.array(np.bincount(text[found], base, len(texts)).astype(np.float64)),
                "score": pa.array(np.bincount(text[found], mixed, len(texts)).astype(np.float64)),
                "rare": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rare)].astype(np.int32)), pa.array(hashes[~found])),
                "spelled": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rare)].astype(np.int32)), pa.array(spelled[~found].astype(np.float32))),
            })

    return score


def score_documents(docs: DataFrame, model: Model, rare: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the log10 probability of the text's words and its end under the model, ``base_score`` that of a
    smoothed word count. A null or empty text is its end alone. Ids may be null or repeat. Without training
    documents every byte is as likely as any other. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        named(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("place"), text_of(text_col).alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = store(rows.mapInArrow(_score_with(sent), f"doc_id {kind}, {SCORED}"), "scored")
    looked_up = (
        scored.select("place", F.explode(F.arrays_zip("rare", "spelled")).alias("w"))
        .select("place", F.col("w.rare").alias("word"), F.col("w.spelled").cast("double").alias("spelled")).join(rare, "word", "left")
        .select("place", "n", "spelled", F.log10(F.coalesce("n", F.lit(0)) + 1.0).alias("base"))
        .select("place", "n", "base", F.log10(F.pow(F.lit(10.0), F.col("base") - model.norm) + F.pow(F.lit(10.0), "spelled")).alias("mixed"))
        .groupBy("place").agg(
            F.count("n").alias("more"), F.sum("base").alias("light"), F.sum(F.col("mixed") - HALF).alias("lighter")
        )
    )
    n = F.lit(model.n).cast("long")
    return scored.drop("rare", "spelled").join(looked_up, "place", "left").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), n.alias("train_tokens"),
        (F.col("heavy") + F.coalesce("light", F.lit(0.0)) - F.col("n_tokens") * F.lit(model.norm)).alias("base_score"),
        (F.col("score") + F.coalesce("lighter", F.lit(0.0))).alias("score"),
    )
