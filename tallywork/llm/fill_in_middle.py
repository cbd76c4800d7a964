"""Fill-in-middle by piece tables: texts are rearranged as lists of descriptors, never as copies.

A document is a table of pieces (buffer, start, length) over two buffers that never change: its own UTF-8 bytes and the
marks. Cutting splits a piece in two, an arrangement is a permutation of pieces, the inverse permutation restores the
text, and a hash streams over the pieces. Bytes are joined only where the output itself is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import named, text_of

#: The marks of prefix, suffix and middle, and the shares in hundredths.
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
TEXT, MARK = 0, 1
#: The pieces before arranging: prefix, middle, suffix, then the three marks.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
#: Bytes of a text that are looked at together; bounds what a long text costs beside itself.
BLOCK = 1 << 20

Piece = tuple[int, int, int]


def cut(table: Sequence[Piece], at: int) -> list[Piece]:
    """``table`` with the piece that holds byte ``at`` split there; either half may be empty."""
    for k, (buffer, start, length) in enumerate(table):
        if at <= length:
            return [*table[:k], (buffer, start, at), (buffer, start + at, length - at), *table[k + 1:]]
        at -= length
    raise ValueError("cut beyond the end")


def arrange(table: Sequence[Piece], order: Sequence[int]) -> list[Piece]:
    return [table[k] for k in order]


def disarrange(table: Sequence[Piece], order: Sequence[int]) -> list[Piece]:
    """The inverse of ``arrange``."""
    return arrange(table, np.argsort(order).tolist())


def views(table: Sequence[Piece], buffers: Sequence[bytes]) -> Iterator[memoryview]:
    for buffer, start, length in table:
        yield memoryview(buffers[buffer])[start: start + length]


def digest(table: Sequence[Piece], buffers: Sequence[bytes]) -> str:
    """SHA-256 of what the pieces say, in lower-case hex."""
    running = hashlib.sha256()
    for view in views(table, buffers):
        running.update(view)
    return running.hexdigest()


def _starts(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Block by block: where it begins, and which of its bytes begin a unit (a run of letters, or another character)."""
    before = False
    for base in range(0, len(text), BLOCK):
        block = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - base), base)
        letter = ((block | 0x20) - np.uint8(97)) < 26
        follows = np.concatenate([[before], letter[:-1]])
        before = bool(letter[-1])
        yield base, (block & 0xC0 != 0x80) & ~(letter & follows)


class Units:
    """The units of a text: how many, and the byte where the k-th begins (or the end)."""

    def __init__(self, text: bytes):
        self.text = text
        self.counts = [int(np.count_nonzero(mask)) for _, mask in _starts(text)]
        self.n = sum(self.counts)

    def offset(self, k: int) -> int:
        if k >= self.n:
            return len(self.text)
        for (base, mask), count in zip(_starts(self.text), self.counts):
            if k < count:
                return base + int(np.flatnonzero(mask)[k])
            k -= count


def characters(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return sum(
        int(np.count_nonzero(np.frombuffer(text, np.uint8, min(BLOCK, len(text) - base), base) & 0xC0 != 0x80))
        for base in range(0, len(text), BLOCK)
    )


def plan(text: bytes, draws: Sequence[int]) -> tuple[int, str, list[Piece], list[Piece]]:
    """(units, form, pieces as cut, pieces as arranged) of a text and its four draws."""
    units = Units(text)
    whole = [(TEXT, 0, len(text))]
    if not text or any(m in text for m in MARKS) or draws[2] % 100 >= PLAIN_FROM:
        return units.n, "plain", whole, whole
    form = "spm" if draws[3] % 100 < SPM_BELOW else "psm"
    places = [units.offset(k) for k in sorted(d % (units.n + 1) for d in draws[:2])]
    pieces = cut(cut(whole, places[0]), places[1])
    marks = [(MARK, sum(map(len, MARKS[:k])), len(m)) for k, m in enumerate(MARKS)]
    return units.n, form, pieces, arrange([*pieces, *marks], ARRANGEMENTS[form])


def restored_pieces(output: bytes, form: str) -> list[Piece]:
    """The pieces of the original text, over the output as their buffer. A mark cannot arise where a segment meets one."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    order = ARRANGEMENTS[form]
    found, table = [output.find(MARKS[k - 3]) for k in order if k >= 3] + [len(output)], []
    for mark, start, end in zip([MARKS[k - 3] for k in order if k >= 3], found, found[1:]):
        table += [(TEXT, start, len(mark)), (TEXT, start + len(mark), end - start - len(mark))]
    return disarrange(table, order)[:3]


PIECES = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("buffer", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()))]))
MADE = (
    ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()),
    ("pieces", PIECES), ("output", T.BinaryType()), ("output_sha256", T.StringType()),
)


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = b"".join(MARKS)
    for batch in batches:
        columns = {name: [] for name, _ in MADE}
        draws = zip(*[batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)])
        for text, drawn in zip(batch.column("text"), draws):
            text = text.as_py()
            n, form, pieces, table = plan(text, drawn)
            buffers = (text, marks)
            sizes = [None if form == "plain" else sum(characters(bytes(v)) for v in views([p], buffers)) for p in pieces[:2]]
            made = (
                n, form, sizes[0], sizes[-1], [{"buffer": b, "start": s, "length": k} for b, s, k in table],
                b"".join(views(table, buffers)), digest(table, buffers),
            )
            for (name, _), value in zip(MADE, made):
                columns[name].append(value)
        kinds = {"pieces": pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))}
        kinds |= {"n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), **{name: pa.array(values, kinds.get(name, pa.string())) for name, values in columns.items()}
        })


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """One row per input row, in place: doc_id, n (units), form (psm, spm, plain), prefix_chars, middle_chars, pieces, output, output_sha256.

    ``pieces`` are the arranged descriptors: buffer 0 is the text in UTF-8, buffer 1 the marks one after another. Cuts and
    form are drawn from the SHA-256 of ``seed`` and id alone, so reruns agree and rows that repeat an id are cut by the
    same draws; a null id draws as an empty one. A null text is empty; empty texts and texts that hold a mark stay plain,
    as does a tenth of the rest, and their two sizes are null. Long texts are looked at block by block. Only two columns
    are read, so no other name can clash.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_col).cast("string"), F.lit(""))), 256)
    given = docs.select(
        named(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"),
        *[F.conv(F.substring(drawn, 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}") for k in (1, 2, 3, 4)],
    )
    schema = T.StructType([given.schema["doc_id"], *[T.StructField(n, t) for n, t in MADE]])
    made = given.mapInArrow(_transformed, schema)
    return made.withColumn("output", F.col("output").cast("string"))


@F.pandas_udf(T.BinaryType())
def _restored(outputs: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([b"".join(views(restored_pieces(o, f), (o,))) for o, f in zip(outputs, forms)], dtype=object)


def restored(output: Column, form: Column) -> Column:
    """The original text from an output and its form alone."""
    return _restored(output.cast("binary"), form).cast("string")
