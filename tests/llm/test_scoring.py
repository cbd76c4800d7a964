"""Mixing, quality, personal data, BPE, language model and toxicity."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallywork.llm import bpe, mixing, pii, quality_rules, queries, suffix_tree_lm, toxicity
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_near_dedup import kept

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_mix_meets_its_targets(make):
    docs = make([(i, "w " * (1 + i % 9), "en", "big" if i % 3 else ("small" if i % 9 else None)) for i in range(300)] + [(999, None, None, "empty")])
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert targets["empty"] == 0 and abs(sum(targets.values()) - total) < 1e-6
    for source, target in targets.items():
        own = [r for r in rows if r["source"] == source]
        assert target <= 3 * own[0]["source_size"] + 1e-9
        assert sum(r["taken"] for r in own) == round(target)
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    words = F.sum(F.regexp_count("text", F.lit(mixing.WORD)))
    assert {r["source"]: r["n"] for r in mixed.groupBy("source").agg(words.alias("n")).collect()} == {
        s: round(t) for s, t in targets.items() if round(t)
    }
    again = mixing.mix(docs.repartition(5).sortWithinPartitions(F.desc("doc_id"))).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_of_repeated_ids_does_not_depend_on_the_input_order(make):
    """The cut falls among rows that share an id or have none."""
    docs = make([(i % 3 if i % 2 else None, "w " * (1 + i), "en", "a") for i in range(40)] + [(100 + i, "v " * 30, "en", "b") for i in range(40)])
    first, second = (sorted(map(tuple, mixing.mix(d).select("doc_id", "size", "taken", "text_hash").collect()), key=repr) for d in (docs, docs.repartition(7)))
    assert first == second and any(0 < r[2] < r[1] for r in first)


def test_prefix_sums_over_partitions(make):
    """One group holds most rows; every row's sum is that of the rows before it in its group."""
    random.seed(4)
    rows = [(i, "x", "en", random.choice(["a", "a", "a", "b", None])) for i in range(500)]
    numbered = make(rows).repartition(5).withColumn("v", F.col("doc_id") % 7)
    got = {r["doc_id"]: r["upto"] for r in mixing.prefix_sums(numbered, ["doc_id"], "v", "upto", "source").collect()}
    sums: dict = {}
    for i, _, _, source in rows:
        sums[source] = sums.get(source, 0) + i % 7
        assert got[i] == sums[source]


def test_mix_of_repeated_and_null_ids(make):
    docs = make([(1, "a b c"), (1, "a b c"), (None, "d e"), (None, None)])
    assert sum(r["taken"] for r in mixing.mix(docs).collect()) == 8
    assert mixing.mixed_rows(docs).count() >= 2
    assert mixing.mix(make([])).count() == 0 and mixing.mixed_rows(make([])).count() == 0


def test_quality_counts(make, edge_rows):
    got = {r["doc_id"]: r for r in quality_rules.quality_report(make(edge_rows)).collect()}
    for row in edge_rows:
        r = got[row[0]]
        want = brute.quality(row[1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_report(make([])).count() == 0 and quality_rules.keep_good(make([])).count() == 0


def test_quality_verdicts(make):
    random.seed(2)
    syllables = "an be co du er fa gi ho ix ja ke lo".split()

    def prose(n):
        return " ".join("".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(n))

    good = [(i, prose(random.randint(60, 200)), "en", "a" if i % 3 else None) for i in range(400)]
    bad = [(1000, prose(90).upper() + "!!", "en", "a"), (1001, prose(90).replace(" ", "### "), "en", None), (1002, prose(30), "xx", "new")]
    docs = make(good + bad)
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs).collect()}
    assert kept == {r[0] for r in good}
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_groups_have_cut_offs_of_their_own(make):
    """The same shouting text stays in a source whose texts vary as much and goes from one where none does; a fifth of junk moves nothing."""
    random.seed(12)
    syllables = "an be co du er fa gi ho ix ja ke lo".split()

    def prose(capitals):
        words = ["".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(120)]
        return " ".join(w.upper() if random.random() < capitals else w for w in words)

    calm = [(i, prose(0), "en", "calm") for i in range(500)]
    loud = [(1000 + i, prose(random.random() * 0.4), "en", "loud") for i in range(500)]
    junk = [(2000 + i, prose(1), "en", "calm") for i in range(100)]
    shout = prose(0.35)
    rows = calm + loud + junk + [(3000, shout, "en", "calm"), (3001, shout, "en", "loud")]
    kept = {r["doc_id"] for r in quality_rules.keep_good(make(rows)).collect()}
    assert 3001 in kept and 3000 not in kept and not kept & {r[0] for r in junk}
    assert len(kept & {r[0] for r in calm + loud}) > 980


def test_quality_separates_labelled_rows(spark):
    found = quality_rules.quality_report(spark.read.parquet(f"{DATA}/documents.parquet"))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = found.join(labels, "doc_id").filter("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()
    assert rows[0] > 0.97


TRICKY = [
    "a.b@c.de_x@y.org, +49 (30) 123-4567. 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112",
    "é😀 mail@x.co 0001.002.3.255 +1 +1((((", "@" * 500, "1" * 3000, "a@" * 400 + "b.c", "a." * 2000 + "@x.y", "9" * 16 + " " + "4242424242424242",
    "write to x@y.z.w. and +123456789012345678", "1.2.3.4" * 50, "+1 2" * 300, "",
]


def test_personal_data(make, documents):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(100, None)] + [(1000 + i, t) for i, t in documents]
    base = [k.name for k in pii.KINDS if k.base]
    for r in pii.pii_spans(make(rows)).collect():
        text = dict(rows)[r["doc_id"]]
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in base] == brute.pii(text)


def test_added_kinds_and_scores(make):
    text = (
        "My IBAN is GB82 WEST 1234 5698 7654 32 now; GB82 WEST 1234 5698 7654 33 is not. SSN 123-45-6789. "
        + "z " * 40 + "987-65-4321 " + "z " * 40 + "call 415-555-1234 " + "z " * 40 + "card 4111111111111111"
    )
    spans = pii.pii_spans(make([(1, text)])).first()["spans"]
    found = [(s["kind"], text[s["start"]: s["end"]]) for s in spans]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in found and len([k for k, _ in found if k == "iban"]) == 1
    assert [m for k, m in found if k == "national_id"] == ["123-45-6789"]
    assert [m.strip() for k, m in found if k == "local_phone"] == ["415-555-1234"]
    assert next(s["score"] for s in spans if s["kind"] == "card") == pytest.approx(1.0)
    assert pii.pii_spans(make([])).count() == 0


def test_bpe_is_the_library(make, edge_rows):
    library = Tokenizer.from_file(VOCABULARY)
    coder = bpe.Coder(bpe.read_vocabulary(VOCABULARY))
    random.seed(1)
    letters = [chr(i) for i in [*range(1, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2030), 0x3000, 0x1F600, 0x4E2D, 0xAC00, 0x1100, 0x1161, 0x301]]
    texts = ["".join(random.choices(letters, k=random.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(random.choices("ab <|endoftext|>'slvre", k=40)) for _ in range(300)]
    texts += ["<|endoftext|> Hi<|startoftext|>x", "</w>a</w>", "ΑΣ ΑΣΑ", "it's I'LL don't'd", "\n", "a" * 3000]
    for text, packed in zip(texts, coder.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == want, text
        assert coder.decode(packed) == library.decode(want, skip_special_tokens=False)
    rows = {r["doc_id"]: r for r in bpe.encode_documents(make(edge_rows), VOCABULARY).collect()}
    for i, text, *_ in edge_rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == want and rows[i]["n_tokens"] == len(want)
        assert rows[i]["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(make([]), VOCABULARY).count() == 0


def test_forced_cuts_lose_no_token():
    coder = bpe.Coder(bpe.read_vocabulary(VOCABULARY))
    letters = {c: b for b, c in enumerate(bpe.byte_letters())}
    assert not coder.inside.all()
    for token in list(coder.tokens)[300:-2:101]:
        data = [letters[c] for c in token.removesuffix(bpe.END)]
        assert all(coder.inside[p] or coder.at_end[p] for p in zip(data, data[1:]))


def test_base_scores_and_model(spark, documents):
    got = {r["doc_id"]: r for r in queries.op5_lm_scoring(spark, DATA).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in documents}
    for i, (tokens, known, n, base) in brute.base_scores(documents, lambda i: not held[i]).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, held[i])
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    tested = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)


def test_control_characters_are_letters_of_their_own(make):
    rows = [(i, "ab\x01 x") for i in range(12)] + [(100 + i, "ab\x00 x") for i in range(12)] + [(200, "ab\x0d x")]
    docs = make(rows)
    got = {r["doc_id"]: r for r in suffix_tree_lm.score_documents(docs, *suffix_tree_lm.train(docs)).collect()}
    for i, (tokens, known, n, base) in brute.base_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2).items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (tokens, known, n)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
    alone = make([(0, "ab\x01 x")])
    unknown = suffix_tree_lm.score_documents(make([(5, "ab\x00 x")]), *suffix_tree_lm.train(alone)).first()
    assert unknown["n_known"] == 2


def test_model_is_a_distribution_over_states(make):
    docs = make([(i, "the cat sat on the mat " * 20) for i in range(30)])
    model, _ = suffix_tree_lm.train(docs)
    shares = 10.0 ** model.logs
    unseen = 256 - len(set(model.column.tolist())) + 1  # bytes that share the last column
    assert np.allclose(shares[:, :-1].sum(axis=1) + unseen * shares[:, -1], 1, atol=1e-3)
    stream = suffix_tree_lm.symbols([b"The cat", b"", b"sat on the mat " * 400])
    pieces, whole = suffix_tree_lm.PIECE, 10**6
    first = model.walk(stream)
    try:
        suffix_tree_lm.PIECE = whole
        assert np.allclose(first, model.walk(stream))
    finally:
        suffix_tree_lm.PIECE = pieces


def test_scores_of_edges(make, edge_rows):
    docs = make(edge_rows + [(None, "one"), (4, "one")])
    rows = suffix_tree_lm.score_documents(docs, *suffix_tree_lm.train(docs)).collect()
    assert len(rows) == len(edge_rows) + 2 and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    empty = make([])
    assert suffix_tree_lm.score_documents(empty, *suffix_tree_lm.train(empty)).count() == 0
    assert suffix_tree_lm.score_documents(docs, *suffix_tree_lm.train(empty)).filter("n_known = 0").count() == len(rows)


def test_machine_is_a_plain_factorization_machine():
    """Scores against the sum over all pairs of terms, and a training step against numerical gradients."""
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(np.arange(12))
    machine.w[:] = rng.normal(0, 1, 13)
    machine.v[:-1] = rng.normal(0, 1, (12, toxicity.RANK))
    rows = [np.sort(rng.choice(12, k, replace=False)) for k in (0, 1, 2, 5, 9)]

    def plain(row):
        pairs = sum(float(machine.v[a] @ machine.v[b]) for n, a in enumerate(row) for b in row[n + 1:])
        return 1 / (1 + np.exp(-(machine.w[12] + machine.w[row].sum() + pairs)))

    assert np.allclose(machine.scores(rows), [plain(r) for r in rows])
    labels = np.array([1.0, 0, 1, 0, 1])

    def loss():
        p = np.array([plain(r) for r in rows])
        decay = toxicity.DECAY / 2 * ((machine.w[:-1] ** 2).sum() + (machine.v[:-1] ** 2).sum())
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean() + decay

    index = np.concatenate([np.append(r, 12) for r in rows])
    sizes = np.array([len(r) + 1 for r in rows])
    used, grad_w, grad_v = machine.gradients(index, np.cumsum(sizes) - sizes, np.repeat(np.arange(5), sizes), labels)
    for place, term in enumerate(used):
        for array, spot, got in [(machine.w, (term,), grad_w[place])] + [(machine.v, (term, f), grad_v[place, f]) for f in range(toxicity.RANK) if term < 12]:
            array[spot] += 1e-6
            high = loss()
            array[spot] -= 2e-6
            low = loss()
            array[spot] += 1e-6
            assert got == pytest.approx((high - low) / 2e-6, abs=1e-5)


def test_toxic_pairs_are_learned(spark, make):
    """Two words that mean nothing alone: only their interaction tells."""
    random.seed(4)
    rows, labels = [], []
    for i in range(1500):
        a, b = random.random() < 0.5, random.random() < 0.5
        words = random.choices([f"w{k}" for k in range(60)], k=25) + ["grumble"] * a + ["zebras"] * b
        random.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    machine = toxicity.train(make(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    scored = {r["doc_id"]: r for r in toxicity.score_documents(make(rows), machine).collect()}
    tested = [(scored[i]["predicted"], y) for i, y in labels if scored[i]["held_out"]]
    assert sum(p == y for p, y in tested) / len(tested) > 0.97


def test_toxicity_on_held_out_rows(spark):
    path = DATA.replace("0.001", "0.01")
    scored = queries.op3_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = ([r for r in scored if r["toxic"] == y] for y in (1, 0))
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert np.mean([r["score"] for r in toxic]) > 0.5 and all(r["predicted"] == (r["score"] >= 0.5) for r in scored)


def test_toxicity_of_edges(spark, make, edge_rows):
    docs = make(edge_rows + [(None, "one")])
    labels = spark.createDataFrame([(4, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == len(edge_rows) + 1 and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score_documents(make([]), toxicity.train(make([]), labels)).count() == 0


def test_pipeline(spark, documents):
    """Stage by stage against plain versions."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        docs = corpus_pipeline.store(stage(spark, docs, DATA), name)
        after = docs.collect()
        ids = sorted(r["doc_id"] for r in after)
        if name != "tokens":
            assert docs.columns == columns
        if name == "quality":
            assert all(len(brute.words(r["text"])) >= 50 for r in after) and len(after) > len(before) / 2
        elif name == "exact_dedup":
            assert ids == sorted(i for i, (_, _, kept, _) in brute.exact(before).items() if kept)
        elif name == "near_dedup":
            assert ids == kept(before)
        elif name == "mixing":
            total = sum(len(brute.words(t)) for _, t in before)
            assert abs(sum(len(brute.words(r["text"])) for r in after) - total) <= 20
        else:
            library = Tokenizer.from_file(VOCABULARY)
            texts = sorted(library.encode(t, add_special_tokens=False).ids for _, t in before)
            assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in after) == texts
    assert corpus_pipeline.run(spark, DATA).count() == len(after)
