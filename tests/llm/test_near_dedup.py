"""The near-duplicate stage against the Jaccard similarity of all pairs."""

import random
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from tallywork.llm import near_dedup, simhash
from tests.conftest import DATA
from tests.llm import brute


def kept(rows):
    """[(doc_id, text)] -> ids that stay: one of each component of pairs with similarity 0.8 or more."""
    sets = {}
    for i, text in rows:
        w = brute.words((text or "").translate(brute.LOWER))
        sets[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(i for i in ids if root[i] == i)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stage_is_brute_force(spark, documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = kept(documents)
    assert ids(corpus_pipeline.near(spark, docs, DATA)) == want and len(want) < len(documents)


def test_edges(make, edge_rows):
    docs = make(edge_rows)
    out = near_dedup.keep_one_of_each(docs)
    assert out.columns == docs.columns and ids(out) == kept([(r[0], r[1]) for r in edge_rows])
    assert near_dedup.keep_one_of_each(make([(None, "same"), (None, "same"), (7, "same"), (7, "same")])).collect()[0]["doc_id"] == 7
    assert near_dedup.keep_one_of_each(make([])).count() == 0


def test_around_the_threshold_beside_a_common_passage(make):
    """Copies from 0.6 to 1 similar, a chain, and a passage that every text holds."""
    random.seed(11)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(random.choices(words, k=40))
    rows = []
    for base in range(25):
        text = random.choices(words, k=random.randint(50, 150))
        for _ in range(4):
            rows.append((len(rows), " ".join(text) + " " + passage))
            for _ in range(random.randint(1, 4)):
                text[random.randrange(len(text))] = random.choice(words)
    want = kept(rows)
    assert 25 < len(want) < 95
    assert ids(near_dedup.keep_one_of_each(make(rows))) == want
    assert ids(near_dedup.keep_one_of_each(make(rows).repartition(7))) == want


def test_first_class_rules_out_no_similar_text(spark):
    """Whatever the class holds: with none or all of the hashes in it, and with batches that hold one text or all."""
    random.seed(3)
    rows, words = [], [f"v{k}" for k in range(500)]
    for _ in range(20):
        text = random.choices(words, k=random.choice([3, 6, 30, 90]))
        for _ in range(3):
            rows.append((len(rows), " ".join(text)))
            text[random.randrange(len(text))] = random.choice(words)
    numbered = [(node, text.encode()) for node, text in rows]
    similar = {i for a in rows for b in rows if a[0] < b[0] and len(kept([a, b])) == 1 for i in (a[0], b[0])}
    assert 10 < len(similar) < 60
    first, near_dedup.FIRST = near_dedup.FIRST, None
    try:
        for size in (0, 20, first, 256):
            near_dedup.FIRST = size
            for step in (1, 7, 60):
                out = []
                for k in range(0, len(numbered), step):
                    nodes, texts = zip(*numbered[k: k + step])
                    batch = pa.record_batch({"node": pa.array(nodes, pa.int64()), "text": pa.array([t.decode() for t in texts])})
                    out += [r for b in near_dedup._first_class(iter([batch])) for r in b.to_pylist()]
                seen = Counter(r["hash"] for r in out)
                m, need = Counter(), {}
                for r in out:
                    if seen[r["hash"]] > 1 or r["sure"]:
                        m[r["node"]] += r["weight"]
                        need[r["node"]] = r["need"]
                assert similar <= {i for i in need if m[i] >= need[i]}
    finally:
        near_dedup.FIRST = first


def test_copies_nearer_to_their_origin_than_to_each_other(make, monkeypatch):
    """Each copy is just similar to one text and to no other copy; few pairs beside those with it are looked at."""
    random.seed(15)
    words = [f"w{k}" for k in range(4000)]
    origin = random.choices(words, k=204)
    rows = [(7, " ".join(origin))]
    for k in range(300):
        text, cuts = list(origin), random.sample(range(0, 204, 12), 3)
        for at in cuts:
            text[min(203, at + random.randrange(8))] = f"own{k}"
        rows.append((100 + k, " ".join(text)))
    stored = {}
    original = near_dedup.store
    monkeypatch.setattr(near_dedup, "store", lambda df, name: stored.setdefault(name, original(df, name)))
    want = kept(rows)
    assert ids(near_dedup.keep_one_of_each(make(rows))) == want
    assert stored["rest"].count() < 2000 and stored["tried"].count() < 2000


def test_large_group_of_near_copies(make):
    """Two thousand near copies in a chain of changes, beside others: one stays, as by all pairs."""
    random.seed(6)
    words = [f"w{k}" for k in range(4000)]
    base = random.choices(words, k=120)
    rows = []
    for k in range(2000):
        text = list(base)
        text[random.randrange(120)] = f"n{k % 40}"
        rows.append((k, " ".join(text)))
    for k in range(50):
        rows.append((3000 + k, " ".join(random.choices(words, k=80) + base[:30])))
    assert ids(near_dedup.keep_one_of_each(make(rows))) == [0, *range(3000, 3050)]


def test_simhash_proposes_pairs(make, monkeypatch):
    """Near copies are linked by what the grid of fingerprints proposes, within its distance; lists look at none of these again."""
    random.seed(8)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for _ in range(30):
        text = random.choices(words, k=150)
        rows.append((len(rows), " ".join(text)))
        for _ in range(2):
            copy = list(text)
            copy[random.randrange(150)] = random.choice(words)
            rows.append((len(rows), " ".join(copy)))
    stored = {}
    original = near_dedup.store
    monkeypatch.setattr(near_dedup, "store", lambda df, name: stored.setdefault(name, original(df, name)))
    want = kept(rows)
    assert ids(near_dedup.keep_one_of_each(make(rows))) == want and len(want) == 30
    pairs = {name: {frozenset((r["a"], r["b"])) for r in stored[name].collect()} for name in ("proposed", "linked", "tried")}
    print_of = {r["node"]: r["print"] for r in stored["shingles"].filter("hash IS NULL").collect()}
    assert len(print_of) == 90
    assert all(((print_of[a] ^ print_of[b]) & (1 << 64) - 1).bit_count() <= 3 for a, b in map(tuple, pairs["proposed"]))
    assert len(pairs["linked"]) > 20 and pairs["linked"] <= pairs["proposed"] and not pairs["linked"] & pairs["tried"]


def test_a_text_that_needs_no_shared_shingle_counts_for_others(make):
    """Pairs of short near copies, of which often one has too few shingles of the first class to need a shared one and the other has not."""
    random.seed(20)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(300):
        text = random.choices(words, k=random.choice([13, 14, 20, 50]))
        rows.append((len(rows), " ".join(text)))
        text[random.choice([0, -1])] = f"own{k}"
        rows.append((len(rows), " ".join(text)))
    want = kept(rows)
    assert 300 <= len(want) < 330
    assert ids(near_dedup.keep_one_of_each(make(rows))) == want


def test_every_pair_of_op4_is_looked_at(make, monkeypatch):
    """What op4's fingerprints link is in one component by then or is held to the similarity, also texts with few shared shingles."""
    random.seed(21)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for k in range(30):
        text = random.choices(words, k=200)
        rows.append((len(rows), " ".join(text)))
        for _ in range(2):
            copy = list(text)
            copy[random.randrange(200)] = random.choice(words)
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), "ho " * 60 + " ".join(random.choices(words, k=30))))
    stored = {}
    original = near_dedup.store
    monkeypatch.setattr(near_dedup, "store", lambda df, name: stored.setdefault(name, original(df, name)))
    docs = make(rows)
    want = kept(rows)
    assert ids(near_dedup.keep_one_of_each(docs)) == want and len(want) == 60
    nodes = {r["node"]: r["text"] for r in docs.selectExpr("xxhash64(text) AS node", "text").collect()}
    prints = {n: simhash.fingerprint(t) for n, t in nodes.items()}
    linked = {(a, b) for a in nodes for b in nodes if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= simhash.MAX_DISTANCE}
    root = {n: n for n in nodes}

    def join(pairs):
        for a, b in pairs:
            x, y = sorted(find(n) for n in (a, b))
            root[y] = x

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    pairs = {name: {(r["a"], r["b"]) for r in stored[name].collect()} for name in ("met", "proposed", "tried", "rest")}
    assert {tuple(sorted(p)) for p in pairs["met"]} <= linked
    one = {r["node"]: r["root"] for r in stored["roots"].collect()}
    seen = {tuple(sorted(p)) for name in ("proposed", "tried", "rest") for p in pairs[name]}
    assert all(one.get(a, a) == one.get(b, b) or tuple(sorted((a, b))) in seen for a, b in pairs["met"])
    join(pairs["met"])
    assert all(find(a) == find(b) for a, b in linked)
    crowd = {n for n, t in nodes.items() if t.startswith("ho ")}
    assert len(crowd) == 30 and len({find(n) for n in crowd}) == 1
    assert len({n for p in pairs["rest"] for n in p} & crowd) == 30
