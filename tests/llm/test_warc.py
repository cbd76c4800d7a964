"""Archives: records, normalising, reading by offset, and the roles of equal payloads."""

import gzip
import hashlib
import io
import random

import pytest

from tallywork.llm import queries, warc
from tallywork.session import new_folder
from tests.conftest import DATA, rows

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def plain(pages):
    """[(page_id, url, html)] -> the query's rows."""
    largest = {}
    for page, _, html in pages:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    out = []
    for page, _, html in pages:
        data, last = (html or "").encode(), largest.get(html or "")
        later = len(data) >= warc.SHARED_BYTES and last is not None and page != last
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if later else "response", last if later else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def edge_pages():
    random.seed(3)
    big = "<p>" + "".join(random.choices("abc é😀\n", k=3000))
    tricky = "x" * 500 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "y" * 600
    return [
        (1, "http://a/", big), (2, "http://b/", big), (3, None, big), (3, "http://c/", big), (None, "http://d/", big),
        (4, "http://e/ f\r\ng", "small"), (5, "http://h/é", "small"), (6, "http://i/", None), (7, "http://j/", ""), (8, "", tricky), (9, "u", tricky),
        (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "u", "é" * 500), (13, "u", "é" * 500), (-5, "u", big * 200), (None, "u", "q" * 2000),
        (14, "u", "\x00\r\n" * 700), (15, "u", "\x00\r\n" * 700),
    ]


def table(spark, pages):
    full = [(*p, "a", "b", "c") for p in pages]
    return spark.createDataFrame(full, "page_id bigint, url string, html string, digest string, payload string, key string")


def test_round_trip(spark, edge_pages):
    out = warc.round_trip(table(spark, edge_pages))
    assert rows(out, *COLUMNS) == plain(edge_pages)
    texts = {(i, h or "") for i, _, h in edge_pages}
    assert all((r["page_id"], r["payload"].decode()) in texts for r in out.filter("payload is not null").collect())
    assert warc.round_trip(table(spark, [])).count() == 0


def test_given_pages(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows(queries.op12_warc(spark, DATA), *COLUMNS) == plain(pages)


def test_archives_are_one_stream_and_then_members(spark, edge_pages):
    whole = warc.write_archives(warc.roles(table(spark, edge_pages)).repartition(3), new_folder(spark, "whole"))
    index = warc.normalise(spark, whole, new_folder(spark, "members"))
    places = index.orderBy("archive", "offset").collect()
    assert len(places) == len(edge_pages) and len({r["archive"] for r in places}) == 3
    for name in {r["archive"] for r in places}:
        data = open(name.removeprefix("file:"), "rb").read()
        own = [r for r in places if r["archive"] == name]
        assert [r["offset"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(data)
        apart = [gzip.decompress(data[r["offset"]: r["offset"] + r["length"]]) for r in own]
        first = gzip.decompress(open(f"{whole}/{name.rsplit('/', 1)[-1]}".removeprefix("file:"), "rb").read())
        assert b"".join(apart) == first and all(a.startswith(b"WARC/1.1\r\n") and a.endswith(b"\r\n\r\n") for a in apart)
    again = warc.normalise(spark, new_name(places), new_folder(spark, "again"))
    strip = [("offset", "length", "record_id")]
    assert rows(again, *strip[0]) == rows(index, *strip[0])


def new_name(places):
    return places[0]["archive"].rsplit("/", 1)[0]


def test_streams_are_cut_by_length_whatever_they_hold():
    records = [f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n".encode() + b"\r\n\r\n" * (n // 4) + b"-" * (n % 4) + b"\r\n\r\n" for n in (0, 3, 5000, 3_000_001, 7)]
    for packed in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert list(warc.Records(warc.inflated(io.BytesIO(packed)))) == records
    with pytest.raises(ValueError):
        list(warc.Records(iter([records[1][:-9]])))


def test_some_records_by_offset(spark, edge_pages):
    whole = warc.write_archives(warc.roles(table(spark, edge_pages)), new_folder(spark, "whole"))
    index = warc.normalise(spark, whole, new_folder(spark, "members"))
    some = warc.read_records(index.filter("record_id = '<urn:page:13>'")).collect()
    assert [r["payload"].decode() for r in some] == ["é" * 500]
