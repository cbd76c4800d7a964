"""WARC archives: written as whole gzip streams, normalised to one gzip member per record with an offset index, read by offset.

Spark's text writer makes the archives: a record is a row of text and the line separator is the end of a record, so each
task's file is one gzip stream of records. Such a file can only be read from its start. The normaliser inflates it once,
as a stream, writes every record as a gzip member of its own, and reports where; those rows are the sidecar index, a
Parquet table. With it records are read one by one, by any number of tasks per archive.

Of records with equal payloads one is stored (response), the others refer to it (revisit) and hold only its headers.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import named, store, text_of
from tallywork.session import new_folder

#: Payloads from this size on are stored once.
SHARED_BYTES = 1000
#: At most so many records go to one file, so that a normalising task has an end.
FILE_RECORDS = 20_000
#: Bytes of archives that one reading task is given.
TASK_BYTES = 64 << 20
#: Bytes inflated, or handed to Spark, at a time.
CHUNK = 1 << 20
BATCH = 8 << 20
LEVEL = 6

#: Fixed values of the format: version line, line and record ends, the profile of a revisit.
VERSION = "WARC/1.1"
LINE, END = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPE, ID, URI, DIGEST, REFERS, LENGTH = "WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "Content-Length"


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, payload (text), digest, record_type, refers_to.

    Payloads are equal when their SHA-256 is. Of equal ones with at least ``SHARED_BYTES`` bytes that with the largest id
    is the response; rows that repeat this id and payload are responses too, a null id is never the largest, and where all
    ids are null all are responses. A null payload is empty. Only digests are grouped, after partial maxima.
    """
    rows = pages.select(
        named(id_col).alias("page_id"), named(url_col).cast("string").alias("url"), text_of(payload_col).alias("payload"),
        F.when(F.octet_length(text_of(payload_col)) >= SHARED_BYTES, F.sha2(text_of(payload_col), 256)).alias("key"),
    )
    shared = rows.filter("key is not null").groupBy("key").agg(F.max("page_id").alias("largest"), F.count("*").alias("copies"))
    later = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.join(shared.filter("copies > 1"), "key", "left").select(
        "page_id", "url", "payload", F.sha1("payload").alias("digest"),
        F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("largest")).alias("refers_to"),
    )


def _urn(column: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(column.cast("string")), F.lit("")), F.lit(">"))


def record(date: str) -> Column:
    """The text of a record, without its end, from the columns of ``roles``."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}{LENGTH}: "), F.octet_length("payload"), F.lit(END)
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]+", "%20")
    lines = [
        F.lit(VERSION), F.concat(F.lit(f"{TYPE}: "), "record_type"), F.concat(F.lit(f"{ID}: "), _urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit(f"{URI}: "), address), F.concat(F.lit(f"{DIGEST}: sha1:"), "digest"),
        F.when(revisit, F.concat(F.lit(f"{REFERS}: "), _urn(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit(f"{LENGTH}: "), size),
    ]
    return F.concat(F.concat_ws(LINE, *lines), F.lit(END), block)


def write_archives(roled: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> str:
    """Archives of the rows of ``roles`` in folder ``path``, each one gzip stream."""
    roled.select(record(date).alias("value")).write.options(
        compression="gzip", lineSep=END, maxRecordsPerFile=FILE_RECORDS
    ).text(path)
    return path


class Records:
    """Cuts a stream of inflated bytes into records; holds one record and a chunk at most."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is not None:
            self.held += chunk
        return chunk is not None

    def __iter__(self) -> Iterator[bytes]:
        while True:
            seen = 0
            while (at := self.held.find(END.encode(), seen)) < 0:
                seen = max(0, len(self.held) - len(END))
                if not self._more():
                    if self.held:
                        raise ValueError("the archive ends within a record")
                    return
            size = at + 2 * len(END) + int(headers(bytes(self.held[:at]))[LENGTH.lower()])
            while len(self.held) < size:
                if not self._more():
                    raise ValueError("the archive ends within a record")
            yield bytes(self.held[:size])
            del self.held[:size]


def headers(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    pairs = (line.split(":", 1) for line in head.decode(errors="replace").split(LINE) if ":" in line)
    return {name.lower(): value.strip() for name, value in pairs}


def inflated(stream) -> Iterator[bytes]:
    """The bytes behind a gzip stream of one or many members, chunk by chunk."""
    opened = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = opened.decompress(data, CHUNK)
            if out:
                yield out
            data = opened.unconsumed_tail
            if opened.eof:
                data, opened = opened.unused_data, zlib.decompressobj(31)
    if rest := opened.flush():
        yield rest


def member(data: bytes) -> bytes:
    """``data`` as a gzip member; the same bytes each time."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI of Spark, and the path in it."""
    if path.startswith(("file:", "/")):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string, uri string, digest string"


def _normalised_into(folder: str):
    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                yield from _rewrite(source, f"{folder}/{source.rsplit('/', 1)[-1]}")

    return normalised


def _rewrite(source: str, target: str) -> Iterator[pa.RecordBatch]:
    """One archive anew. It gets its name when whole, so that a lost or repeated task leaves no half of one."""
    system, path = _system(target)
    unfinished, rows, offset = f"{path}.{uuid.uuid4().hex}", [], 0
    inside, where = _system(source)
    with inside.open_input_stream(where, compression=None) as stream, system.open_output_stream(unfinished, compression=None) as sink:
        for data in Records(inflated(stream)):
            packed = member(data)
            sink.write(packed)
            found = headers(data[: data.index(END.encode())])
            rows.append((target, offset, len(packed), found[ID.lower()], found[TYPE.lower()], found.get(URI.lower()), found.get(DIGEST.lower())))
            offset += len(packed)
    system.move(unfinished, path)
    names = [part.split()[0] for part in INDEX.split(", ")]
    for start in range(0, len(rows), 10_000):
        part = list(zip(*rows[start: start + 10_000]))
        yield pa.record_batch({n: pa.array(v, pa.int64() if n in ("offset", "length") else pa.string()) for n, v in zip(names, part)})


def normalise(spark: SparkSession, archives: str, folder: str) -> DataFrame:
    """Every record of the archives in folder ``archives`` as its own gzip member, in archives of the same names in ``folder``.

    Returns the index, a stored table: archive, offset, length, record_id, record_type, uri, digest. Whole-file streams
    and files of many members are both read. Spark lists the files and deals them out by size; a task holds one record.
    """
    files = spark.read.format("binaryFile").load(archives).filter("length > 0").select("path")
    system, path = _system(folder)
    system.create_dir(path, recursive=True)
    return store(files.mapInArrow(_normalised_into(folder), INDEX), "warc-index")


RECORD = "record_id string, record_type string, uri string, digest string, refers_to string, payload binary, payload_length bigint"


def parse(data: bytes) -> tuple:
    """The columns of ``read_records`` from one record."""
    end = END.encode()
    at = data.index(end)
    found = headers(data[:at])
    block = data[at + len(end): at + len(end) + int(found[LENGTH.lower()])]
    split = block.index(end)
    length = int(headers(block[:split])[LENGTH.lower()])
    payload = None if found[TYPE.lower()] == "revisit" else block[split + len(end):]
    return (
        found[ID.lower()], found[TYPE.lower()], found.get(URI.lower()), found[DIGEST.lower()].removeprefix("sha1:"),
        found.get(REFERS.lower()), payload, length,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
    names = [part.split()[0] for part in RECORD.split(", ")]
    return pa.record_batch({n: pa.array(v, kinds.get(n, pa.string())) for n, v in zip(names, zip(*rows))})


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, name, rows, size = None, None, [], 0
    for batch in batches:
        for archive, offset, length in zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")]):
            if archive != name:
                system, path = _system(archive)
                opened, name = system.open_input_file(path), archive
            opened.seek(offset)
            row = parse(zlib.decompress(opened.read(length), 31))
            rows.append(row)
            size += len(row[5] or b"")
            if size >= BATCH:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def read_records(index: DataFrame) -> DataFrame:
    """The records that rows of the index point at: record_id, record_type, uri, digest, refers_to, payload, payload_length.

    A revisit has a null payload and the length of the one it refers to. Neighbours in an archive are read together, and
    an archive by as many tasks as the index spreads over.
    """
    places = index.select("archive", "offset", "length")
    size = places.agg(F.sum("length")).first()[0] or 0
    # Rows of the index are short and what they point at is not: a number by those bytes, which Spark keeps.
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    spread = places.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(_fetched, RECORD)


def page_of(urn: Column, kind: T.DataType) -> Column:
    """The id that ``_urn`` wrote; null for none."""
    return F.url_decode(F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit(""))).cast(kind)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages through archives and back, one row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, uri, payload.

    Size and digest of a response are those of the payload as read; a revisit has those of its header. See ``roles`` for
    nulls, ties and repeated rows; other columns are not read, and an empty table gives an empty result.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    archives = write_archives(roles(pages, id_col, url_col, payload_col), new_folder(spark, "warc-whole"))
    found = read_records(normalise(spark, archives, new_folder(spark, "warc")))
    return found.select(
        page_of(F.col("record_id"), kind).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "digest").alias("payload_digest"),
        "record_type", page_of(F.col("refers_to"), kind).alias("refers_to"), "uri", "payload",
    )
