"""Fill-in-middle against plain string work, and piece tables by themselves."""

import hashlib
import random
import re

from hypothesis import given
from hypothesis import strategies as st

from tallywork.llm import fill_in_middle as fim
from tallywork.llm import queries
from tests.conftest import DATA


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    drawn = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * k: 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rows(make, edge_rows):
    tricky = [(100 + i, t) for i, t in enumerate(["<", "<P", "P>", "<<P>", "S><", "<M>", "<S>" * 3, "a<b<S", "\n\r\x00é", "<" * 50, "a", "😀"] * 6)]
    rows = [*edge_rows, *tricky, (None, "no id"), (None, None), (100, "<"), (9999, "né w " * 700_000)]
    out = fim.transform(make(rows))
    got = out.withColumn("restored", fim.restored(out["output"], out["form"])).collect()
    assert len(got) == len(rows)
    for (doc_id, text, *_), r in zip(rows, got):
        want = plain(doc_id, text)
        assert (r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (doc_id, *want)
        assert r["output_sha256"] == sha(want[4]) and r["restored"] == (text or "")
        buffers = ((text or "").encode(), b"".join(fim.MARKS))
        assert b"".join(fim.views([tuple(p) for p in r["pieces"]], buffers)).decode() == want[4]
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(make([])).count() == 0


def test_given_documents(spark, documents):
    got = {r["doc_id"]: r for r in queries.op13_fill_in_middle(spark, DATA).collect()}
    for doc_id, text in documents:
        n, form, prefix, middle, output = plain(doc_id, text)
        r = got[doc_id]
        assert tuple(r) == (doc_id, n, form, prefix, middle, sha(output), sha(text or ""))


@given(st.text(), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_any_text_comes_back(text, draws):
    n, form, pieces, table = fim.plan(text.encode(), draws)
    buffers = (text.encode(), b"".join(fim.MARKS))
    assert n == len(re.findall("[A-Za-z]+|[^A-Za-z]", text))
    output = b"".join(fim.views(table, buffers))
    assert b"".join(fim.views(fim.restored_pieces(output, form), (output,))).decode() == text
    assert b"".join(fim.views(pieces, buffers)).decode() == text and fim.digest(table, buffers) == hashlib.sha256(output).hexdigest()


def test_pieces():
    random.seed(8)
    buffers = [bytes(random.choices(range(97, 123), k=60))]
    table = [(0, 0, 60)]
    for _ in range(12):
        table = fim.cut(table, random.randint(0, 60))
        assert b"".join(fim.views(table, buffers)) == buffers[0]
    order = random.sample(range(len(table)), len(table))
    assert fim.disarrange(fim.arrange(table, order), order) == table


def test_units_across_blocks():
    text = ("ab é1<x" * 40).encode()
    whole = fim.Units(text)
    want = whole.n, [whole.offset(k) for k in range(whole.n + 1)]
    size, fim.BLOCK = fim.BLOCK, 7
    try:
        parts = fim.Units(text)
        assert (parts.n, [parts.offset(k) for k in range(parts.n + 1)]) == want
        assert fim.characters(text) == len(text.decode())
    finally:
        fim.BLOCK = size
