"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

from tallywork.llm import collocations as co
from tests.llm import brute


def plain(rows, least, top=co.TOP):
    """[(text, lang)] -> the result rows, by dictionaries."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\f\r]", (text or "").translate(brute.LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i: i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    replaced = set()
    for (lang, words), f in frequent.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (lang, words[i: i + k])
                if 100 * f >= 80 * counts[inner]:
                    replaced.add(inner)
    out = []
    for (lang, words), a in frequent.items():
        cuts = [(co.SCALE * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if (lang, words) not in replaced:
            out.append((lang, -score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]], totals[lang]))
    ranked, place = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, left, right, n, -score))
    return sorted(ranked)


def prose(n, seed):
    random.seed(seed)
    letters = ["a", "b", "C", "d", "é", "\x01", "b\x02", "日"]
    weights = [12, 8, 5, 3, 3, 1, 1, 2]
    return "".join(random.choices(letters, weights)[0] + random.choices([" ", "\t", ". ", "\n", "  "], [30, 2, 2, 1, 1])[0] for _ in range(n))


def result(df):
    return sorted(map(tuple, df.collect()))


def test_counts_are_plain_counts(make, monkeypatch):
    """Few words, so that one word begins most phrases and its extensions lie in several partitions."""
    rows = [(i, prose(random.randint(0, 400), i), random.choice(["en", "de", None, "und"]), "s") for i in range(120)]
    rows += [(500, None, "en", "s"), (501, "", None, "s"), (502, ". . .", "xx", "s"), (None, rows[0][1], "en", None), (0, rows[0][1], "en", "s")]
    docs = make(rows)
    for least in (3, 30):
        monkeypatch.setattr(co, "LEAST", least)
        want = plain([r[1:3] for r in rows], least)
        assert len(want) > 20 and result(co.collocations(docs)) == want
    monkeypatch.setattr(co, "LEAST", 3)
    assert result(co.collocations(docs.repartition(9), top=5)) == plain([r[1:3] for r in rows], 3, 5)


def test_paths_over_many_partitions(spark, make, monkeypatch):
    monkeypatch.setattr(co, "LEAST", 2)
    rows = [(i, prose(300, i)) for i in range(30)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(co.collocations(make(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain([(t, "en") for _, t in rows], 2)


def test_edges(make, edge_rows):
    assert co.collocations(make([])).count() == 0
    assert co.collocations(make([(1, None), (2, ""), (3, "...")])).count() == 0
    want = plain([(r[1], r[2] if len(r) > 2 else "en") for r in edge_rows], co.LEAST)
    assert result(co.collocations(make(edge_rows))) == want and want


def test_slices_end_with_pieces():
    whole, sliced = co.Chunk(), co.Chunk()
    text = prose(3000, 1).encode()
    whole.add("en", text)
    size, co.SLICE = co.SLICE, 64
    try:
        sliced.add("en", text)
        assert len(sliced.parts) > len(whole.parts)
    finally:
        co.SLICE = size
    trim = [list(filter(None, b"".join(bytes([min(1, t)]) for t in c.tokens()).split(b"\0"))) for c in (whole, sliced)]
    assert trim[0] == trim[1] and whole.known == sliced.known


def test_products_beyond_64_bits(spark):
    """Counts near the end of 64 bits: scores stay exact."""
    big = 6 * 10**18
    found = spark.createDataFrame(
        [("en", "", big), ("en", "a", big), ("en", "b", big - 5), ("en", "a b", big - 7), ("en", "c", big), ("en", "b c", 10), ("en", "a b c", 8)],
        "lang string, phrase string, f bigint",
    )
    got = {r["phrase"]: r for r in co.scored(found).collect()}
    assert got["a b"]["score"] == co.SCALE * (big - 7) // (2 * big - 5) and got["a b"]["best"] == 8
    assert got["a b c"]["score"] == 0 and (got["a b c"]["l"], got["a b c"]["r"]) == (big, 10)
