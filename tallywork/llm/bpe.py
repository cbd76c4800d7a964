"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged, so a text may
be cut there for certain. Every pre-token is cut at such pairs, the fragments are encoded on their
own and their ids are concatenated. The words of a block of texts that a worker has not met before are
encoded together, as arrays of symbols in which every fragment makes its next merge in the same
step; a cache of bounded size keeps them.

The vocabulary file is read on the driver and sent as a broadcast of fixed size, about 2 MB. Texts stay
in their partitions: no shuffle. Ids are stored packed, as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import named, text_of

CACHE = 200_000
BLOCK = 1_000_000
NONE = 1 << 40
END = "</w>"
#: Fixed: white space of the tokenizer's patterns, inside a character class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """What encoding needs from a tokenizer file with word ends (``</w>``)."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model = data["model"]
    return {
        "vocab": model["vocab"], "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "special": {t["content"]: t["id"] for t in data["added_tokens"]},
        "pattern": data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
    }


class Coder:
    """Encodes and decodes with one vocabulary; merges run over arrays of many words at once."""

    def __init__(self, tables: dict):
        ids, self.special = tables["vocab"], tables["special"]
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.middle = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + END] for c in letters], np.int64)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in tables["merges"]], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([ids[a + b] for a, b in tables["merges"]], np.int64)
        # Where what a merge makes is used by later merges only, no merge can come before another of its own rank.
        used = np.full(len(self.tokens), NONE, np.int64)
        for side in (0, 1):
            np.minimum.at(used, np.array([ids[m[side]] for m in tables["merges"]], np.int64), np.arange(len(keys)))
        self.in_order = bool((used[self.made] > np.arange(len(keys))).all())
        # Pairs of bytes that some token holds: elsewhere a cut is certain. The last byte of a word is a case of its own.
        self.inside, self.at_end = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
        number = {c: b for b, c in enumerate(letters)}
        for token in ids:
            bare = token.removesuffix(END) if len(token) > len(END) else token
            held = [number[c] for c in bare if c in number]
            pairs = list(zip(held, held[1:]))
            if bare != token and pairs:
                self.at_end[pairs.pop()] = True
            for pair in pairs:
                self.inside[pair] = True
        # White space only separates, so texts need no squeezing first; for ASCII the classes are plain ranges.
        self.words = regex.compile(tables["pattern"].replace(r"\s", SPACE))
        plain = tables["pattern"].replace(r"\s", r"\t-\r ").replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
        self.ascii_words = re.compile(plain)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where there is no merge."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merged(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in ``data`` (bytes; a word ends where ``ends``), and at which byte each id starts."""
        symbols = np.where(ends, self.last[data], self.middle[data])
        cut = np.ones(len(data), bool)  # a fragment ends here
        pairs = np.where(ends[1:], self.at_end[data[:-1], data[1:]], self.inside[data[:-1], data[1:]])
        cut[:-1] = ends[:-1] | ~pairs
        final, place = np.full(len(data), -1, np.int64), np.arange(len(data))
        rank = np.full(len(data), NONE, np.int64)
        open_ = np.flatnonzero(~cut)
        rank[open_] = self._ranks(symbols[open_], symbols[open_ + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, cut[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            done = np.repeat(least == NONE, sizes)
            if done.any():
                final[place[done]] = symbols[done]
                going = ~done
                symbols, cut, rank, place = symbols[going], cut[going], rank[going], place[going]
                least, sizes = least[least != NONE], sizes[least != NONE]
                if not len(symbols):
                    break
            fragment = np.repeat(np.arange(len(sizes)), sizes)
            best = np.flatnonzero(rank == least[fragment])
            if self.in_order:  # all of its next merge, leftmost first: every other one where they overlap
                first = np.r_[True, best[1:] != best[:-1] + 1]
                best = best[(best - best[first][np.cumsum(first) - 1]) % 2 == 0]
            else:  # the leftmost of each fragment
                best = best[np.r_[True, fragment[best[1:]] != fragment[best[:-1]]]]
            symbols[best] = self.made[rank[best]]
            cut[best] = cut[best + 1]
            keep = np.ones(len(symbols), bool)
            keep[best + 1] = False
            symbols, cut, rank, place = symbols[keep], cut[keep], rank[keep], place[keep]
            best -= np.arange(len(best))
            touched = np.unique(np.concatenate([best, best[best > 0] - 1]))
            rank[touched] = NONE
            touched = touched[~cut[touched]]
            rank[touched] = self._ranks(symbols[touched], symbols[touched + 1])
        at = np.flatnonzero(final >= 0)
        return final[at], at

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        stops = np.cumsum(sizes)
        ends = np.zeros(int(stops[-1]), bool)
        ends[stops - 1] = True
        ids, at = self.merged(np.frombuffer(b"".join(raw), np.uint8), ends)
        packed, bounds = ids.astype("<u4").tobytes(), (4 * np.searchsorted(at, stops)).tolist()
        self.known.update(zip(words, [packed[a:b] for a, b in zip([0, *bounds], bounds)]))

    def _parts(self, text: str) -> list[str]:
        """Plain stretches and, at odd places, the special tokens between them."""
        if self.marks is None or not any(mark in text for mark in self.special):
            return [text]
        return self.marks.split(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        return self.words.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [[p if i % 2 else self._words(p) for i, p in enumerate(self._parts(t))] for t in texts]
        seen = set().union(*[p for text in parts for p in text[::2]])
        new = seen - self.known.keys()
        if new and len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = seen
        if new:
            self._learn(list(new))
        of = self.known.__getitem__
        return [
            b"".join(np.array(self.special[p], "<u4").tobytes() if i % 2 else b"".join(map(of, p)) for i, p in enumerate(text))
            for text in parts
        ]

    def decode(self, packed: bytes) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about ``BLOCK`` letters."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


_CODERS: dict[str, Coder] = {}


def _coder(tables, key: str) -> Coder:
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(tables.value)
    return _CODERS[key]


def codec(spark: SparkSession, vocabulary: str):
    """Two column functions: texts to packed ids, packed ids to texts."""
    tables = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    key = f"{spark.sparkContext.applicationId}:{vocabulary}"

    @F.pandas_udf(T.BinaryType())
    def encode(texts: pd.Series) -> pd.Series:
        coder = _coder(tables, key)
        return pd.Series([ids for block in blocks(texts.tolist()) for ids in coder.encode(block)], dtype=object)

    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(_coder(tables, key).decode)

    return encode, decode


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, in place: doc_id, ids (packed), n_tokens, decoded.

    Encodes as the file's own library does without special tokens added: a special token's string in a text is
    that token. A null or empty text has no ids and decodes to the empty text. Rows that repeat, null ids and very
    long texts (encoded whole) need no care; other columns are not read.
    """
    encode, decode = codec(docs.sparkSession, vocabulary)
    coded = docs.select(named(id_col).alias("doc_id"), encode(text_of(text_col)).alias("ids"))
    return coded.select(
        "doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), decode("ids").alias("decoded")
    )
