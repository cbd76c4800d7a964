"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere are removed.

Not every suffix is sorted. Every window of ``LENGTH`` bytes has an anchor, the ``CORE``-byte string of least hash in
it (the first of several); equal windows have their anchors at the same offset. So only suffixes at anchors
matter, about one in 150, and of these only those whose core occurs again. An anchor's context is what its windows can
reach: ``LENGTH`` - ``CORE`` bytes before it and ``LENGTH`` bytes from it on.

Equal contexts count as one with its number of occurrences; whatever windows they hold are repeated. Where a core has
several contexts, Spark brings them together and each task orders them by deep-shallow sorting: multikey sorting, 8 bytes
at a time and only of strings still tied, down to a shallow depth, then a blind trie for every group that is tied there. The contexts read
backwards are ordered alike. From the two orders and their common prefixes follow the classes of equal windows at each
offset; a window is repeated if its class has two occurrences. All repeated windows of one anchor overlap in its
core, so they cover one span, from the largest to the smallest repeated offset.

Repeats that are too short to be removed show in ``n_shared``: every window of ``SHORT`` bytes has an anchor in the same
way, and it counts the anchors whose core occurs again, at least one in any repeat of that length.

A core with more than ``CROWD`` contexts is not brought into one task: its windows are counted by their 128-bit hash,
which Spark sums before it shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import named, store, text_of

LENGTH = 400
CORE = 100
REACH = LENGTH - CORE
#: Repeats from this length on are told, though not removed.
SHORT = 200
CROWD = 20_000
BLOCK = 2_000_000
ROWS = 20_000
SHALLOW = 16  # words of eight bytes

_RANDOM = np.random.default_rng(77)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E37_79B9_7F4A_7C15
_BACK = pow(_BASE, -1, 2**64)
_MIX = np.uint64(0xFF51_AFD7_ED55_8CCD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hash of any substring of ``data`` in constant time (a polynomial modulo 2**64, then mixed)."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=self.sums[1:])
        self.back = _powers(_BACK, len(data) + 1)

    def of(self, start, stop) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    on = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(on[:n], upto[width - 1: width - 1 + n])


def _core_hashes(data: np.ndarray) -> tuple[Hashes, np.ndarray]:
    hashes = Hashes(data)
    at = np.arange(max(0, len(data) - CORE + 1))
    return hashes, hashes.of(at, at + CORE)


def anchored(cores: np.ndarray, stops: np.ndarray, length: int) -> np.ndarray:
    """Places of the anchors of all windows of ``length`` bytes in texts that lie one after the other."""
    if len(cores) < length - CORE + 1:
        return np.zeros(0, np.int64)
    order = (cores >> np.uint64(32) << np.uint64(32)) | np.arange(len(cores), dtype=np.uint64)
    least = sliding_least(order, length - CORE + 1)
    inside = np.arange(len(least)) + length <= np.repeat(stops, np.diff(np.r_[0, stops]))[: len(least)]
    return np.unique((least[inside] & np.uint64(0xFFFF_FFFF)).astype(np.int64))


def anchors(hashes: Hashes, cores: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of the windows that count, with the hashes of their cores and contexts."""
    found = anchored(cores, stops, LENGTH)
    sizes = np.diff(np.r_[0, stops])
    stop_of, start_of = np.repeat(stops, sizes), np.repeat(stops - sizes, sizes)
    left, right = np.maximum(found - REACH, start_of[found]), np.minimum(found + LENGTH, stop_of[found])
    context = hashes.of(left, right) ^ _mixed((found - left).astype(np.uint64) << np.uint64(20) | (right - found).astype(np.uint64))
    return found, cores[found].view(np.int64), context.view(np.int64)


PIECES = (
    "place bigint, n_bytes bigint, whole string, packed binary, at array<int>, core array<bigint>, context array<bigint>, "
    "sure int, lone array<bigint>, recurring array<bigint>"
)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values))


def _short_anchors(cores: np.ndarray, stops: np.ndarray) -> dict[str, pa.Array]:
    """Cores at the anchors of short windows, by text: those that stand alone in this block, and each other one once.

    What recurs in the block needs no asking; ``sure`` counts it. So a core in very many texts leaves a block as one row.
    """
    at = anchored(cores, stops, SHORT)
    text = np.searchsorted(stops, at, side="right")
    values, first, back, counts = np.unique(cores[at].view(np.int64), return_index=True, return_inverse=True, return_counts=True)
    several = counts[back] > 1
    once = np.zeros(len(at), bool)
    once[first] = True
    chosen = {"lone": ~several, "recurring": several & once}
    n = len(stops)
    return {"sure": pa.array(np.bincount(text[several], minlength=n).astype(np.int32))} | {
        name: _lists(cores[at[mask]].view(np.int64), np.bincount(text[mask], minlength=n)) for name, mask in chosen.items()
    }


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed, with their anchors and the SHA-256 of the whole."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [t.as_py().encode() for t in batch.column("text")]
        sizes = np.array([len(t) for t in texts], np.int64)
        reached = np.cumsum(sizes)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(reached, (reached[first - 1] if first else 0) + BLOCK)))
            part, own = texts[first:last], sizes[first:last]
            stops = np.cumsum(own)
            hashes, cores = _core_hashes(np.frombuffer(b"".join(part), np.uint8))
            found, core, context = anchors(hashes, cores, stops)
            near = _short_anchors(cores, stops)
            text = np.searchsorted(stops, found, side="right")
            counts = np.bincount(text, minlength=len(part))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").slice(first, last - first), "place": batch.column("place").slice(first, last - first),
                "n_bytes": pa.array(own), "whole": pa.array([hashlib.sha256(t).hexdigest() for t in part]),
                "packed": pa.array([pack(t) for t in part], pa.binary()),
                "at": _lists((found - (stops - own)[text]).astype(np.int32), counts),
                "core": _lists(core, counts), "context": _lists(context, counts), **near,
            })
            first = last


class BlindTrie:
    """Orders strings that share a long prefix: nodes keep a depth and the byte that tells their branches apart there.

    A string goes down by these bytes alone, is compared with the one leaf it meets, and is hung in where it
    first differs. Strings that end early read as zeros.
    """

    def __init__(self):
        self.root = None

    @staticmethod
    def _same(a: bytes, b: bytes) -> int:
        low, high = 0, len(a)
        while low < high:
            middle = (low + high + 1) // 2
            if a[low:middle] == b[low:middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def add(self, text: bytes, row: int) -> None:
        if self.root is None:
            self.root = (text, [row])
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        same = self._same(text, node[0])
        if same == len(text):
            node[1].append(row)
            return
        above, node = None, self.root
        while isinstance(node, list) and node[0] < same:
            above, node = node, node[1][text[node[0]]]
        leaf = (text, [row])
        if isinstance(node, list) and node[0] == same:
            node[1][text[same]] = leaf
            return
        other = node
        while isinstance(other, list):
            other = next(iter(other[1].values()))
        fork = [same, {text[same]: leaf, other[0][same]: node}]
        if above is None:
            self.root = fork
        else:
            above[1][text[above[0]]] = fork

    def rows(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node[1]
        return out


def multikey(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of ``words`` by group and content, and where a row of it equals the one before.

    The first word splits all groups; each next one splits only the runs that are equal so far.
    """
    order = np.lexsort((words[:, 0], group))
    tied = (group[order[1:]] == group[order[:-1]]) & (words[order[1:], 0] == words[order[:-1], 0])
    for k in range(1, words.shape[1]):
        inside = np.flatnonzero(np.r_[tied, False] | np.r_[False, tied])
        if not len(inside):
            break
        rows, run = order[inside], np.cumsum(~np.r_[False, tied][inside])
        rows = rows[np.lexsort((words[rows, k], run))]
        order[inside] = rows
        later = np.r_[False, tied][inside]
        tied[inside[later] - 1] = words[rows[later], k] == words[rows[np.flatnonzero(later) - 1], k]
    return order, tied


def deep_shallow(strings: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``strings`` (zero-filled to ``width``) by group and content, and each one's common prefix with the one before."""
    n = len(strings)
    full = [s.ljust(width, b"\0") for s in strings]
    words = np.frombuffer(b"".join(full), ">u8").reshape(n, width // 8)
    shallow = min(SHALLOW, width // 8)
    order, tied = multikey(words[:, :shallow], group)
    edges = np.flatnonzero(np.diff(np.r_[False, tied, False].astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):  # rows a to b of the order share the shallow prefix
        trie = BlindTrie()
        for row in order[a: b + 1].tolist():
            trie.add(full[row], row)
        order[a: b + 1] = trie.rows()
    common = np.zeros(n, np.int64)
    data = words.view(np.uint8).reshape(n, width)
    for a in range(1, n, 4096):
        b = min(n, a + 4096)
        differ = data[order[a:b]] != data[order[a - 1: b - 1]]
        common[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[np.r_[True, group[order[1:]] != group[order[:-1]]][:n]] = -1
    return order, common


def repeated_offsets(
    group: np.ndarray, left: list[bytes], right: list[bytes], times: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest offset of a repeated window in each context (-1: none). ``left`` is read backwards from the anchor."""
    n = len(group)
    lowest, highest = np.full(n, -1), np.full(n, -1)
    before, after = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    orders = [deep_shallow(side, group, width) for side, width in ((left, -(-REACH // 8) * 8), (right, LENGTH))]

    def classes(side: int, depth: int) -> np.ndarray:
        order, common = orders[side]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    for offset in range(REACH + 1):
        fits = np.flatnonzero((before >= offset) & (after >= LENGTH - offset))
        if len(fits):
            key = classes(0, offset)[fits] * (n + 1) + classes(1, LENGTH - offset)[fits]
            _, which = np.unique(key, return_inverse=True)
            again = fits[np.bincount(which, times[fits])[which] >= 2]
            lowest[again] = np.where(lowest[again] < 0, offset, lowest[again])
            highest[again] = offset
    return lowest, highest


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by core; whole groups are worked on together, about ``ROWS`` rows at a time."""
    held: list[tuple] = []

    def work(rows: list[tuple]) -> pa.RecordBatch:
        core = np.array([r[0] for r in rows], np.int64)
        group = np.cumsum(np.r_[True, core[1:] != core[:-1]])
        low, high = repeated_offsets(group, [r[3] for r in rows], [r[4] for r in rows], np.array([r[2] for r in rows]))
        keep = low >= 0
        return pa.record_batch({
            "core": pa.array(core[keep]), "context": pa.array(np.array([r[1] for r in rows], np.int64)[keep]),
            "low": pa.array(low[keep].astype(np.int32)), "high": pa.array(high[keep].astype(np.int32)),
        })

    for batch in batches:
        held += zip(*[batch.column(c).to_pylist() for c in ("core", "context", "n", "left", "right")])
        while len(held) > ROWS and held[0][0] != held[-1][0]:
            stop = min(ROWS, len(held) - 1)
            while stop > 0 and held[stop][0] == held[stop - 1][0]:
                stop -= 1
            if stop == 0:  # the first group alone is larger
                stop = next(i for i, r in enumerate(held) if r[0] != held[0][0])
            yield work(held[:stop])
            held = held[stop:]
    if held:
        yield work(held)


SIDES = T.ArrayType(T.StructType([T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())]))


@F.pandas_udf(SIDES)
def contexts_at(packed: pd.Series, places: pd.Series) -> pd.Series:
    """The bytes before each place, backwards, and from it on."""
    unpack = zstandard.ZstdDecompressor().decompress

    def of(data, at):
        text = unpack(data)
        return [{"left": text[max(0, p - REACH): p][::-1], "right": text[p: p + LENGTH]} for p in at]

    return pd.Series([of(data, at) for data, at in zip(packed, places)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("window", T.BinaryType())])))
def windows_of(left: pd.Series, right: pd.Series) -> pd.Series:
    def of(a, b):
        text, anchor = a[::-1] + b, len(a)
        return [
            {"offset": o, "window": hashlib.blake2b(text[anchor - o: anchor - o + LENGTH], digest_size=16).digest()}
            for o in range(max(0, LENGTH - len(b)), min(REACH, len(a)) + 1)
        ]

    return pd.Series([of(a, b) for a, b in zip(left, right)], dtype=object)


def _crowded(contexts: DataFrame) -> DataFrame:
    """The same answer as ``_sorted_groups`` for cores with very many contexts, without bringing them together."""
    windows = contexts.select("core", "context", "n", F.explode(windows_of("left", "right")).alias("w")).select(
        "core", "context", "n", "w.offset", "w.window"
    )
    again = windows.groupBy("core", "offset", "window").agg(F.sum("n").alias("all")).filter("all >= 2").drop("all")
    return windows.join(again, ["core", "offset", "window"]).groupBy("core", "context").agg(
        F.min("offset").alias("low"), F.max("offset").alias("high")
    )


@F.pandas_udf(T.StructType([
    T.StructField("kept", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))
]))
def without_spans(packed: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
    """Texts without the merged spans."""
    unpack = zstandard.ZstdDecompressor().decompress
    out = []
    for data, a, b in zip(packed, starts, stops):
        text, spans, kept, at = unpack(data), [], [], 0
        for start, stop in sorted(zip(a, b)):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], stop)
            else:
                spans.append([start, stop])
        for start, stop in spans:
            kept.append(text[at:start])
            at = stop
        out.append((b"".join([*kept, text[at:]]), sum(b - a for a, b in spans), spans))
    return pd.DataFrame(out, columns=["kept", "n_removed", "spans"])


def repeated_spans(pieces: DataFrame) -> DataFrame:
    """(place, starts, stops): per text the spans to remove, not merged yet."""
    found = pieces.select("place", "n_bytes", F.explode(F.arrays_zip("at", "core", "context")).alias("a")).select(
        "place", "n_bytes", "a.at", "a.core", "a.context"
    )
    distinct = store(
        found.groupBy("core", "context").agg(F.count("*").alias("n"), F.min(F.struct("place", "at")).alias("one")), "contexts"
    )
    # Stored, so that Spark can split a core with many contexts in the join.
    several = store(distinct.groupBy("core").agg(F.count("*").alias("m")).filter("m > 1"), "several")
    apart = distinct.join(several, "core").select("core", "context", "n", "m", "one.place", "one.at")
    listed = apart.groupBy("place").agg(F.collect_list(F.struct("core", "context", "n", "m", "at")).alias("asked"))
    shown = listed.join(pieces.select("place", "packed"), "place").select(
        "asked", contexts_at("packed", F.col("asked.at")).alias("sides")
    )
    contexts = shown.select(F.explode(F.arrays_zip("asked", "sides")).alias("x")).select(
        "x.asked.core", "x.asked.context", "x.asked.n", "x.asked.m", "x.sides.left", "x.sides.right"
    )
    contexts = store(contexts, "sides")
    usual = contexts.filter(F.col("m") <= CROWD).repartition("core").sortWithinPartitions("core")
    answers = usual.select("core", "context", "n", "left", "right").mapInArrow(
        _sorted_groups, "core bigint, context bigint, low int, high int"
    ).union(_crowded(contexts.filter(F.col("m") > CROWD)))
    # Equal contexts repeat every window that they hold.
    whole = distinct.filter("n > 1").select("core", "context", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    partial = answers.join(whole.select("core", "context"), ["core", "context"], "left_anti")
    spans = found.join(whole.union(partial), ["core", "context"]).select(
        "place",
        (F.col("at") - F.coalesce("high", F.least(F.col("at"), F.lit(REACH)))).cast("long").alias("start"),
        (F.col("at") + LENGTH - F.coalesce("low", F.greatest(F.lit(0), F.col("at") + LENGTH - F.col("n_bytes")))).cast("long").alias("stop"),
    )
    return spans.groupBy("place").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")
    ).select("place", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))


def shared_anchors(pieces: DataFrame) -> DataFrame:
    """(place, n_shared): the anchors of short windows whose core occurs again, for texts that have some."""
    cores = pieces.select("place", F.explode(F.concat(
        F.transform("lone", lambda c: F.struct(c.alias("core"), F.lit(1).alias("weight"))),
        F.transform("recurring", lambda c: F.struct(c.alias("core"), F.lit(0).alias("weight"))),
    )).alias("a")).select("place", "a.core", "a.weight")
    met = cores.withColumn("n", F.count("*").over(Window.partitionBy("core"))).filter("n > 1").select("place", "weight")
    sure = pieces.select("place", F.col("sure").alias("weight"))
    return met.union(sure).groupBy("place").agg(F.sum("weight").alias("n_shared"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (merged, start and stop), kept (bytes), whole_sha256, n_shared.

    ``spans`` and ``kept`` are null where nothing is removed; the text is then whole. Strings are judged on the input, and both
    of two equal strings go, also within one document; matches do not cross documents. A null or short text loses
    nothing. Rows that repeat an id are documents of their own. Other columns are not read.
    """
    rows = docs.select(
        named(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("place"), text_of(text_col).alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = store(rows.mapInArrow(_cut, f"doc_id {kind}, {PIECES}"), "pieces")
    joined = pieces.select("doc_id", "place", "n_bytes", "whole", "packed").join(repeated_spans(pieces), "place", "left").join(
        shared_anchors(pieces), "place", "left"
    )
    cut = F.when(F.col("starts").isNotNull(), without_spans("packed", F.coalesce("starts", F.array()), F.coalesce("stops", F.array())))
    return joined.select("doc_id", "n_bytes", F.col("whole").alias("whole_sha256"), cut.alias("cut"), "n_shared").select(
        "doc_id", "n_bytes", F.coalesce("cut.n_removed", F.lit(0)).cast("long").alias("n_removed"), "cut.spans", "cut.kept", "whole_sha256",
        F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
    )
