"""Phrase collocations from sorted count streams, as n-gram models are estimated outside memory.

Counts of phrases of one to four words are kept as two streams: in prefix order (words from the left), where a phrase
directly follows the ones it begins with, and in suffix order (words from the right), where it follows the ones it ends
with. One walk along each stream, with the phrases that the current one extends at hand (at most three), gives the count
of its left parts or of its right parts and the best count among its extensions by a word. No phrase is looked up by
hash. A stream is range-partitioned, so that the extensions of one word spread over tasks; what a partition needs from
those before it is the path to its first phrase, at most three counts.

Only phrases seen ``LEAST`` times are kept, and every part of such a phrase is one too. So words and pairs are counted
first, then phrases of three and four words all of whose pairs are frequent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import named, store, text_of
from tallywork.session import materialise

LEAST = 30
LONGEST = 4
TOP = 2000
SCALE = 2_000_000
#: A longer phrase with this share of a phrase's count, in hundredths, replaces it.
SHARE = 80
#: Tokens that are counted together in a task; bounds its memory.
CHUNK = 500_000
#: Rows that leave a task at a time.
BATCH = 100_000
#: A text is cut into tokens in slices of about so many bytes.
SLICE = 1 << 20
#: Bits, as a power of two, of the filter of frequent pairs; of fixed size, it only saves work.
BITS = 27
_READ = bytes(
    10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Words of one language to numbers; new ones are entered in ``known``, the shared list of (language, word)."""

    def __init__(self, lang: str, known: list[tuple[str, bytes]]):
        super().__init__({b"": -1, b"\n": 0})
        self.lang, self.known = lang, known

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.known)
        self.known.append((self.lang, word))
        return number


def _slices(data: bytes) -> Iterator[bytes]:
    """``data`` in slices that end where a piece does, of ``SLICE`` bytes or as long as a piece is."""
    start = 0
    while start < len(data):
        end = data.find(b"\n", start + SLICE)
        end = len(data) if end < 0 else end + 1
        yield data[start:end]
        start = end


class Chunk:
    """Tokens of some documents as numbers, 0 after each piece; the counts of their phrases."""

    def __init__(self):
        self.known: list[tuple[str, bytes]] = [("", b"")]
        self.langs: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        numbers = self.langs.setdefault(lang, _Numbers(lang, self.known))
        for part in _slices(text.translate(_READ)):
            tokens = part.replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
            self.parts += [found[found >= 0], np.zeros(1, np.int64)]
            self.size += len(self.parts[-2])

    def tokens(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        return _hashes(self.known)

    def batches(self, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Phrases given by the numbers of their words, one array per place."""
        langs = pa.array([lang for lang, _ in self.known], pa.string())
        words = pa.array([word for _, word in self.known], pa.binary())
        for at in range(0, len(counts), BATCH):
            part = [pa.array(c[at: at + BATCH]) for c in columns]
            phrases = pc.binary_join_element_wise(*[words.take(c) for c in part], pa.scalar(b" "))
            yield pa.record_batch({"lang": langs.take(part[0]), "phrase": phrases, "f": pa.array(counts[at: at + BATCH], pa.int64())})


def _hashes(words: Iterable[tuple[str, bytes]]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(word, zlib.crc32(lang.encode())) for lang, word in words], np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            chunk.add(lang, text.as_py())
            if chunk.size >= CHUNK:
                yield chunk
                chunk = Chunk()
    yield chunk


def _words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs; the empty phrase counts all words of a language."""
    for chunk in _chunks(batches):
        tokens, n = chunk.tokens(), len(chunk.known)
        counts = np.bincount(tokens, minlength=n)[1:]
        if not counts.any():
            continue
        yield from chunk.batches([np.arange(1, n)], counts)
        langs = pa.array([lang for lang, _ in chunk.known[1:]])
        totals = pa.table({"lang": langs, "f": counts}).group_by("lang").aggregate([("f", "sum")])
        yield pa.record_batch({
            "lang": totals["lang"].combine_chunks(), "phrase": pa.array([b""] * len(totals), pa.binary()),
            "f": totals["f_sum"].combine_chunks().cast(pa.int64()),
        })
        first, second = tokens[:-1], tokens[1:]
        keys, counts = np.unique((first * n + second)[(first > 0) & (second > 0)], return_counts=True)
        yield from chunk.batches([keys // n, keys % n], counts)


def _slots(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter for pairs of word hashes."""
    mixed = (first ^ first >> np.uint64(31)) * _MIX + second
    mixed = (mixed ^ mixed >> np.uint64(29)) * _MIX
    low = np.uint64((1 << BITS) - 1)
    return (mixed & low).astype(np.int64), (mixed >> np.uint64(32) & low).astype(np.int64)


def _pair_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for name in ("first", "second"):
            sides.append(_hashes(zip(batch.column("lang").to_pylist(), batch.column(name).to_pylist())))
        at = np.concatenate(_slots(*sides))
        yield pa.record_batch({"at": pa.array(at >> 6), "bit": pa.array(np.int64(1) << (at & 63))})


def _filter(pairs: DataFrame) -> np.ndarray:
    """A bitmap of 2^BITS bits that holds every pair of ``pairs``."""
    sides = F.split("phrase", " ")
    placed = pairs.select("lang", *[F.get(sides, F.lit(k)).cast("binary").alias(n) for k, n in enumerate(("first", "second"))])
    found = placed.mapInArrow(_pair_slots, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(1 << BITS - 6, np.int64)
    words[found.column("at").to_numpy()] = found.column("bit").to_numpy()
    return words


def _longer_with(sent):
    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of phrases of three words and more whose pairs are all in the filter."""
        held = sent.value
        for chunk in _chunks(batches):
            tokens, n, hashes = chunk.tokens(), len(chunk.known), chunk.hashes()
            at = np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))
            ends = []
            for slots in _slots(hashes[tokens[at]], hashes[tokens[at + 1]]):
                ends.append(held[slots >> 6] >> (slots & 63) & 1)
            frequent = np.zeros(len(tokens), bool)
            frequent[at[(ends[0] & ends[1]).astype(bool)]] = True
            shorter = tokens
            for words in range(2, LONGEST + 1):
                # Where a phrase of so many words may begin; ``shorter`` numbers the one without its last word.
                span = len(tokens) - words + 1
                start = np.flatnonzero(np.logical_and.reduce([frequent[k: span + k] for k in range(words - 1)])) if span > 0 else at[:0]
                keys, places, numbers, counts = np.unique(
                    shorter[start] * n + tokens[start + words - 1], return_index=True, return_inverse=True, return_counts=True
                )
                if words > 2:
                    yield from chunk.batches([tokens[start[places] + k] for k in range(words)], counts)
                shorter = np.zeros(len(tokens), np.int64)
                shorter[start] = numbers

    return longer


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, f of all phrases of up to ``LONGEST`` words seen ``LEAST`` times; the empty phrase has the number of all words."""
    read = docs.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).cast("binary").alias("text"))
    schema = "lang string, phrase binary, f bigint"

    def kept(found: DataFrame) -> DataFrame:
        summed = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        return summed.filter((F.col("f") >= LEAST) | (F.octet_length("phrase") == 0)).withColumn("phrase", F.col("phrase").cast("string"))

    short = store(kept(read.mapInArrow(_words_and_pairs, schema)), "phrases")
    pairs = short.filter(F.contains("phrase", F.lit(" ")))
    sent = docs.sparkSession.sparkContext.broadcast(_filter(pairs))
    return store(short.unionByName(kept(read.mapInArrow(_longer_with(sent), schema))), "phrases")


# Walks along a stream ------------------------------------------------------------------------------------------------

PLACE = "place"
Entry = list  # language, words, count (None if of an earlier partition), counts of its parts, best count of its extensions


def _begins(entry: Entry, lang: str, words: list[str]) -> bool:
    return entry[0] == lang and len(entry[1]) < len(words) and words[: len(entry[1])] == entry[1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[str], int]]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in (PLACE, "lang", "words", "f")])


def _last_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path to the last phrase of a partition, as far as the partition holds it."""
    path, place = [], None
    for place, lang, words, f in _rows(batches):
        while path and not _begins(path[-1], lang, words):
            path.pop()
        path.append([lang, words, f])
    if path:
        langs, words, counts = zip(*path)
        yield pa.record_batch({
            PLACE: pa.array([place] * len(path), pa.int32()), "lang": pa.array(langs), "words": pa.array(words, pa.list_(pa.string())),
            "f": pa.array(counts, pa.int64()),
        })


def _carried(stream: DataFrame) -> dict[int, list[Entry]]:
    """For each partition the path that leads to it; a few rows per partition come to the driver."""
    ends: dict[int, list[Entry]] = {}
    for row in stream.mapInArrow(_last_paths, stream.select(PLACE, "lang", "words", "f").schema).toLocalIterator():
        ends.setdefault(row[PLACE], []).append([row["lang"], list(row["words"]), row["f"]])
    path, before = [], {}
    for place in sorted(ends):
        before[place] = path
        own = sorted(ends[place], key=lambda e: len(e[1]))
        path = [e for e in path if _begins(e, *own[0][:2])] + own
    return before


def _walked_with(sent):
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each phrase with the counts of the phrases it begins with, and the best count of those that extend it by a word."""
        path: list[Entry] | None = None
        done: list[Entry] = []
        for place, lang, words, f in _rows(batches):
            if path is None:
                path = [[e[0], e[1], None, [], 0, e[2]] for e in sent.value.get(place, [])]
            while path and not _begins(path[-1], lang, words):
                done.append(path.pop())
            if path:
                path[-1][4] = max(path[-1][4], f)
            path.append([lang, words, f, [e[5] for e in path], 0, f])
            if len(done) >= 20_000:
                yield _walked_batch(done)
                done = []
        done += path or []
        if done:
            yield _walked_batch(done)

    return walked


def _walked_batch(entries: list[Entry]) -> pa.RecordBatch:
    langs, words, counts, parts, best, _ = zip(*entries)
    return pa.record_batch({
        "lang": pa.array(langs), "words": pa.array(words, pa.list_(pa.string())), "a": pa.array(counts, pa.int64()),
        "parts": pa.array(parts, pa.list_(pa.int64())), "best": pa.array(best, pa.int64()),
    })


def walk(stream: DataFrame) -> DataFrame:
    """lang, words, a, parts, best along ``stream`` (lang, words, f), which holds every phrase that another begins with.

    A phrase whose extensions reach into later partitions has a further row there, with a null ``a``.
    """
    placed = materialise(
        stream.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words").withColumn(PLACE, F.spark_partition_id())
    )
    sent = stream.sparkSession.sparkContext.broadcast(_carried(placed))
    return placed.mapInArrow(_walked_with(sent), "lang string, words array<string>, a bigint, parts array<bigint>, best bigint")


def _exact(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score, best of every phrase of two words and more; ``best`` is the highest count of a longer one."""
    phrases = found.filter("phrase != ''").select("lang", F.split("phrase", " ").alias("words"), "f")
    left = walk(phrases)
    right = walk(phrases.withColumn("words", F.reverse("words")))
    none = F.lit(None).cast("array<bigint>")
    both = left.select("lang", "words", "a", F.col("parts").alias("left"), none.alias("right"), "best").union(
        right.select("lang", F.reverse("words"), "a", none, "parts", "best")
    ).filter(F.size("words") > 1)
    # In one range order, equal phrases of both streams lie side by side; the grouping needs no further exchange.
    side_by_side = both.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    merged = side_by_side.groupBy("lang", "words").agg(*[F.max(c).alias(c) for c in ("a", "left", "right", "best")])
    n = F.size("words")
    cuts = []
    for k in range(1, LONGEST):
        # A phrase without rows of its own in a partition has empty lists there; the maximum passes over them.
        first, rest = F.get("left", F.lit(k - 1)), F.get("right", n - k - 1)
        score = F.lit(SCALE).cast("decimal(7,0)") * _exact(F.col("a"))
        cuts.append(F.when(n > k, F.struct(
            F.call_function("div", score, _exact(first) + _exact(rest)).alias("score"), F.lit(k).alias("k"), first.alias("l"), rest.alias("r")
        )))
    worst = F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull()))
    return merged.select("lang", F.array_join("words", " ").alias("phrase"), "a", worst.alias("cut"), "best").select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "best"
    )


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are what white space leaves of the pieces between punctuation; A to Z are lower-cased. A phrase is as good as
    its worst cut, a share of its count in those of both parts, in whole millionths times two; it goes if a longer one
    has four fifths of its count (the best longer one has one word more). Ties go to the higher count, then to byte order.
    A null language is ``und``, a null text empty; repeated rows count again; an empty table gives an empty result. A
    text is read in slices of pieces, whatever its length. Only two columns are read.
    """
    found = counts(docs, lang_col, text_col)
    kept = scored(found).filter(_exact(F.col("best")) * 100 < _exact(F.col("a")) * SHARE)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = found.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
