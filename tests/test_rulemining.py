"""Word-set rules against counting all sets."""

import itertools
import random

import numpy as np
import pytest

from tallywork.operators import rulemining as rm


def texts_of(seed, n):
    random.seed(seed)
    vocabulary, weights = [f"w{chr(97 + k)}" for k in range(20)], [1 / (k + 1) for k in range(20)]
    rows = []
    for i in range(n):
        passed = random.choice([True, True, False, None])
        words = random.choices(vocabulary, weights, k=random.randint(0, 9)) + (["bad", "worse"] if not passed and random.random() < 0.6 else [])
        rows.append((random.choice([i, i, 7]), " ".join(words).replace("wa", "Wa"), passed))
    return rows + [(5000, None, True), (5001, "", None), (5002, "...", True)]


def brute(rows, share, contrast, longest):
    """(words, passed) -> (support, confidence, examples)."""
    sets = [(i, bool(p), set((t or "").lower().replace(".", " ").split())) for i, t, p in rows]
    size = {o: sum(p == o for _, p, _ in sets) for o in (False, True)}
    words = sorted(set().union(*[s for _, _, s in sets]))
    out = {}
    for k in range(1, longest + 1):
        for group in itertools.combinations(words, k):
            held = {o: sorted(i for i, p, s in sets if p == o and s >= set(group)) for o in (False, True)}
            for o in (False, True):
                own, other = len(held[o]), len(held[not o])
                if own and own >= share * size[o] and own / size[o] >= contrast * (other / max(1, size[not o])):
                    out[group, o] = (own, own / (own + other), held[o][: rm.EXAMPLES])
    return out


def mined(df, **options):
    return {(tuple(r.words), r.passed): (r.support, r.confidence, list(r.examples)) for r in rm.mine_rules(df, **options).collect()}


SCHEMA = "id bigint, text string, passed boolean"


@pytest.mark.parametrize("share, contrast, longest", [(0.1, 1.2, 3), (0.3, 0.0, 2), (0.05, 2.0, 2)])
def test_rules_are_those_of_all_sets(spark, share, contrast, longest):
    rows = texts_of(longest, 150)
    want = brute(rows, share, contrast, longest)
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(6), share=share, contrast=contrast, longest=longest)
    assert got == want and len(want) > 5 and any(len(w) == longest for w, _ in want)


def test_parts_of_any_size_and_slices_lose_nothing(spark, monkeypatch):
    """Many small parts: a set frequent in all of them together is frequent in one; candidates go out in several slices."""
    rows = texts_of(9, 120)
    monkeypatch.setattr(rm, "CHUNK_TEXTS", 20)
    monkeypatch.setattr(rm, "SLICE", 50)
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(7), share=0.2, contrast=1.0)
    assert got == brute(rows, 0.2, 1.0, 2)


def test_local_sets_hold_every_frequent_one():
    random.seed(1)
    rows = [(i, i % 3 == 0, [w for w in "abcdef" if random.random() < 0.5]) for i in range(90)]
    whole = {s for s in itertools.chain(*[itertools.combinations("abcdef", k) for k in (1, 2, 3)]) if any(
        sum(p == o and set(s) <= set(w) for _, p, w in rows) >= 0.2 * sum(p == o for _, p, _ in rows) for o in (False, True))}
    union = set()
    for start in range(0, 90, 9):
        part = rm.Part(rows[start: start + 9])
        union |= {tuple(part.words[k] for k in s) for s in rm.frequent_sets(part, 0.2, 3)}
    assert whole and whole <= union


def test_bitmaps_and_counts():
    part = rm.Part([(3, True, ["b"]), (1, True, ["a", "b"]), (None, False, ["c"]), (2, True, [])])
    assert part.words == ["a", "b", "c"] and part.ids == [[None], [1, 2, 3]]
    assert [np.unpackbits(m, axis=1)[:, :3].tolist() for m in part.bits(np.arange(3))] == [
        [[0, 0, 0], [0, 0, 0], [1, 0, 0]], [[1, 0, 0], [1, 0, 1], [0, 0, 0]],
    ]


def test_no_rows_no_rules(spark):
    assert rm.mine_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, "x y", True), (2, "x", True)], SCHEMA)
    assert {(w, p): s for (w, p), (s, *_) in mined(only, share=0.5).items()} == {(("x",), True): 2, (("y",), True): 1, (("x", "y"), True): 1}
