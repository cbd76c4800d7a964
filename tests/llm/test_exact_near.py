"""Exact copies, near copies, repeated lines and repeated byte strings against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.llm import exact_dedup, line_dedup, queries, simhash, suffix_array
from tallywork.llm.components import components
from tests.conftest import DATA
from tests.llm import brute


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_copies(make, edge_rows, fan_in):
    docs = make(edge_rows).repartition(7)
    got = by_id(exact_dedup.exact_dedup(docs, fan_in=fan_in), "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute.exact([(r[0], r[1]) for r in edge_rows])


def test_exact_copies_with_null_and_repeated_ids(make):
    docs = make([(None, "same"), (None, "same"), (7, "sa me"), (7, "sa me"), (8, "same")])
    assert exact_dedup.exact_dedup(docs).filter("kept").count() == 1
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [7]
    assert exact_dedup.drop_exact_copies(make([(None, "same"), (None, "same")])).count() == 1


def test_near_copies(spark, documents):
    assert by_id(queries.op4_simhash(spark, DATA), "fingerprint", "component_id") == brute.near(documents)


def test_near_copies_of_edges(make, edge_rows):
    got = by_id(simhash.near_duplicates(make(edge_rows)), "fingerprint", "component_id")
    assert got == brute.near([(r[0], r[1]) for r in edge_rows])
    kept = simhash.keep_one_of_each(make(edge_rows + [(None, "one"), (7, edge_rows[6][1])]))
    want = {component for _, component in brute.near([(r[0], r[1]) for r in edge_rows]).values()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_links_lose_nothing(spark):
    """All pairs within three bits of dense random prints, each once."""
    import random

    random.seed(3)
    prints = set()
    for _ in range(60):
        center = random.getrandbits(64)
        prints |= {center ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for _ in range(8)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "print bigint")).collect()
    pairs = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert len(got) == len(pairs) and {tuple(sorted(r)) for r in got} == pairs


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(edges).collect()} == {0}


def test_lines(make):
    docs = make([(1, "a\nb\nc\n\nd"), (2, "x\n a \n\nb\nc\ny"), (3, "a\nb\nc\na\nb\nc"), (4, None), (5, "a\nb"), (None, "a\nb\nc")])
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {
        1: (4, 0, "a\nb\nc\n\nd"), 2: (5, 3, "x\n\ny"), 3: (6, 6, ""), 4: (0, 0, ""), 5: (2, 0, "a\nb"), None: (3, 3, ""),
    }


def test_byte_strings(spark, documents):
    got = by_id(queries.op8_suffix_array(spark, DATA), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(documents, suffix_array.LENGTH)


@pytest.mark.parametrize("crowd", [suffix_array.CROWD, 1])
def test_byte_strings_of_edges(make, edge_rows, crowd, monkeypatch):
    """Both ways of handling a core, one forced by a small limit; short pieces shared in many surroundings."""
    import random

    random.seed(9)
    core = "".join(random.choices("abcdefgh ", k=430))
    shared = [(100 + n, "".join(random.choices("abcdefgh ", k=n * 37)) + core[n:] + "".join(random.choices("ab\0", k=300))) for n in range(12)]
    rows = [(r[0], r[1]) for r in edge_rows if r[0] not in (10, 11)] + shared
    monkeypatch.setattr(suffix_array, "CROWD", crowd)
    found = suffix_array.suffix_dedup(make(rows)).select(
        "doc_id", "n_bytes", "n_removed", F.coalesce(F.size("spans"), F.lit(0)).alias("n"), F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("sha")
    )
    assert by_id(found, "n_bytes", "n_removed", "n", "sha") == brute.repeats(rows, suffix_array.LENGTH)


def test_deep_shallow_order():
    import numpy as np

    strings = [b"a" * 200 + bytes([k % 7]) * (k % 5) + b"b" for k in range(60)] + [b"", b"a", b"z" * 400]
    group = np.array([k % 3 for k in range(len(strings))])
    order, common = suffix_array.deep_shallow(strings, group, 400)
    full = [(g, s.ljust(400, b"\0")) for g, s in zip(group, strings)]
    assert [full[i] for i in order] == sorted(full)
    for (ga, a), (gb, b), same in zip(sorted(full), sorted(full)[1:], common[1:]):
        assert same == (-1 if ga != gb else next((i for i in range(400) if a[i] != b[i]), 400))


def test_empty_tables(make):
    empty = make([])
    for df in (
        exact_dedup.exact_dedup(empty), exact_dedup.drop_exact_copies(empty), simhash.near_duplicates(empty),
        simhash.keep_one_of_each(empty), line_dedup.line_dedup(empty), suffix_array.suffix_dedup(empty),
    ):
        assert df.count() == 0


def test_multikey_sorting_refines_ties_only():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 400):
        words = rng.integers(0, 3, (n, 5)).astype(">u8")
        group = np.sort(rng.integers(0, 4, n))
        order, tied = suffix_array.multikey(words, group)
        keys = [(int(group[k]), *map(int, words[k])) for k in range(n)]
        assert [keys[k] for k in order] == sorted(keys)
        assert tied.tolist() == [keys[a] == keys[b] for a, b in zip(order, order[1:])]


def test_short_repeats_show(make):
    """A repeat of 200 bytes has a shared anchor, and a text with one repeats 100 bytes; whatever block the texts lie in."""
    random.seed(21)
    letters = "abcdefghij klmnop"
    passages = ["".join(random.choices(letters, k=random.choice([90, 150, 200, 260, 399]))) for _ in range(30)]
    rows = []
    for i in range(120):
        inside = random.choice(passages) if i % 3 else ""
        rows.append((i, "".join(random.choices(letters, k=random.randint(0, 300))) + inside + "".join(random.choices(letters, k=random.randint(0, 300)))))
    rows += [(500, "x" * 1000), (501, None), (502, passages[-1] * 2)]
    got = {r["doc_id"]: r["n_shared"] for r in suffix_array.suffix_dedup(make(rows).repartition(3)).collect()}

    def repeating(width):
        seen = {}
        for i, text in rows:
            for k in range(len(text or "") - width + 1):
                seen.setdefault(text[k: k + width], []).append(i)
        return {i for ids in seen.values() if len(ids) > 1 for i in ids}

    shared = {i for i, n in got.items() if n}
    assert repeating(suffix_array.SHORT) <= shared <= repeating(suffix_array.CORE) and 20 < len(shared) < 100
