"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of a text: each term has a weight, and
each pair of terms an interaction through short vectors, so that two words may count together what
neither counts alone.

Terms are a text's distinct words and their beginnings (four and five letters), hashed to 32 bits. Spark counts
in how many toxic and other training texts each hash occurs; every hash in at least ``MIN_TEXTS`` of them whose association
with the label is strong (a log-likelihood ratio of at least ``MIN_EVIDENCE``) is a term of the model. Training takes at
most ``MAX_LABELLED`` labelled texts, those of the smallest hash of their id, which bounds the terms as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import named, store, text_of

MAX_LABELLED = 50_000
MIN_TEXTS = 3
MIN_EVIDENCE = 8.0
RANK = 4
EPOCHS = 12
BATCH = 256
STEP = 0.2
DECAY = 1e-4
CACHE = 200_000
BEGINNINGS = (4, 5)
FOLDS = 5
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_"


def word_terms(word: str) -> set[int]:
    """Hashes of a lower-case word and its beginnings; kinds do not mix."""
    word = word.strip(_EDGES)
    if not word:
        return set()
    return {zlib.crc32(("w" + word).encode()), *(zlib.crc32(f"{n}{word[:n]}".encode()) for n in BEGINNINGS if len(word) >= n)}


class Terms:
    """Terms of texts; words are looked up in a cache of bounded size."""

    def __init__(self, numbers: dict[int, int] | None = None):
        self.numbers, self.known = numbers, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = word_terms(word)
        if self.numbers is not None:
            found = {self.numbers[t] for t in found if t in self.numbers}
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = out = tuple(found)
        return out

    def of_text(self, text: str) -> np.ndarray:
        out: set[int] = set()
        known = self.known
        for word in set(text.lower().split()):
            terms = known.get(word)
            out.update(self.of_word(word) if terms is None else terms)
        return np.sort(np.fromiter(out, np.int64, len(out)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def all_terms(texts: pd.Series) -> pd.Series:
    terms = Terms()
    return texts.map(terms.of_text)


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    """Whether a row is kept from training; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds == 0


class Machine:
    """Weights ``w`` (n + 1, the last is the constant) and vectors ``v`` (n + 1, RANK) over numbered terms."""

    def __init__(self, hashes: np.ndarray, seed: int = 7):
        n = len(hashes)
        self.hashes = hashes
        self.w = np.zeros(n + 1)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n + 1, RANK))
        self.v[n] = 0

    def raw(self, index: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid and the sums of vectors; every row has at least the constant."""
        v = self.v[index]
        sums = np.add.reduceat(v, starts, axis=0)
        squares = np.add.reduceat(v * v, starts, axis=0)
        return np.add.reduceat(self.w[index], starts) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def gradients(self, index: np.ndarray, starts: np.ndarray, row: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms of a batch and the gradients of their weights and vectors: mean loss, decay of what is used."""
        constant = len(self.hashes)
        y, sums = self.raw(index, starts)
        error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels)[row] / len(labels)
        used, where = np.unique(index, return_inverse=True)
        grad_w = np.bincount(where, error, len(used)) + DECAY * self.w[used] * (used != constant)
        pull = error[:, None] * (sums[row] - self.v[index])
        grad_v = np.stack([np.bincount(where, pull[:, f], len(used)) for f in range(RANK)], axis=1) + DECAY * self.v[used]
        grad_v[used == constant] = 0
        return used, grad_w, grad_v

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> None:
        """Logistic loss, AdaGrad; the same rows in the same order give the same machine."""
        constant = len(self.hashes)
        base = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        self.w[constant] = np.log(base / (1 - base))
        full = [np.append(r, constant) for r in rows]
        order, past_w, past_v = np.random.default_rng(seed), np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(EPOCHS):
            shuffled = order.permutation(len(full))
            for at in range(0, len(full), BATCH):
                take = shuffled[at: at + BATCH]
                part = [full[i] for i in take]
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                index, starts, row = np.concatenate(part), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(part)), sizes)
                used, grad_w, grad_v = self.gradients(index, starts, row, labels[take])
                past_w[used] += grad_w**2
                past_v[used] += grad_v**2
                self.w[used] -= STEP * grad_w / np.sqrt(past_w[used])
                self.v[used] -= STEP * grad_v / np.sqrt(past_v[used])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        full = [np.append(r, len(self.hashes)) for r in rows]
        sizes = np.fromiter(map(len, full), np.int64, len(full))
        y, _ = self.raw(np.concatenate(full), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(y, -700, 700)))


def _evidence(texts: Column, toxic: Column, all_texts: int, all_toxic: int) -> Column:
    """Log-likelihood ratio of a term and the label."""
    def cell(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))

    share = all_toxic / all_texts
    rest, rest_toxic = all_texts - texts, F.lit(all_toxic) - toxic
    return 2 * (
        cell(toxic, texts * share) + cell(texts - toxic, texts * (1 - share))
        + cell(rest_toxic, rest * share) + cell(rest - rest_toxic, rest * (1 - share))
    )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine from the labelled documents that are not held out; null labels are left out.

    Without any training text, or with labels all alike, the machine knows no terms and gives the base rate.
    """
    chosen = (
        labels.select(named(id_col).alias("doc_id"), named(label_col).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(MAX_LABELLED)
    )
    chosen = store(chosen, "labelled")
    texts = docs.select(named(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # At most MAX_LABELLED rows of two numbers are broadcast.
    rows = store(
        texts.join(F.broadcast(chosen), "doc_id").select("doc_id", (F.col("label") > 0).cast("int").alias("label"), all_terms("text").alias("terms")),
        "terms",
    )
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not total or toxic in (0, total):
        machine = Machine(np.zeros(0, np.int64))
        share = min(max((toxic + 0.5) / (total + 1), 1e-3), 1 - 1e-3)
        machine.w[0] = np.log(share / (1 - share))
        return machine
    counted = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("texts"), F.sum("label").alias("toxic")
    )
    strong = (
        counted.filter(F.col("texts") >= MIN_TEXTS)
        .select("term", _evidence(F.col("texts"), F.col("toxic"), total, toxic).alias("evidence"))
        .filter(F.col("evidence") >= MIN_EVIDENCE)
    )
    hashes = np.sort(np.array([r[0] for r in strong.select("term").collect()], np.int64))
    machine = Machine(hashes)
    machine.fit(*_picked(rows, hashes))
    return machine


def _picked(rows: DataFrame, hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The training texts reduced to the model's terms, which is little, in a fixed order."""
    sent = rows.sparkSession.sparkContext.broadcast(hashes)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def numbers(terms: pd.Series) -> pd.Series:
        def of(found):
            at = np.searchsorted(sent.value, found)
            at[at == len(sent.value)] = 0
            return at[sent.value[at] == found] if len(sent.value) else at[:0]

        return terms.map(lambda t: of(np.asarray(t, np.int64)))

    got = rows.select("doc_id", "label", numbers("terms").alias("terms")).toArrow().sort_by(
        [("doc_id", "ascending"), ("label", "ascending")]
    )
    lists = got.column("terms").combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])], got.column("label").to_numpy().astype(float)


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    A null or empty text has no terms and scores the constant. Labels are not looked at; only the text
    makes the score, so rows that repeat a text score alike. No shuffle; the machine's size is fixed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        terms = Terms({int(h): i for i, h in enumerate(model.hashes)})
        for texts in batches:
            yield pd.Series(model.scores([terms.of_text(t) for t in texts]), dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = docs.select(
        named(id_col).alias("doc_id"), held_out(named(id_col)).alias("held_out"),
        F.pandas_udf(score, T.DoubleType())(text_of(text_col)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
