"""Words within 40 characters of a match, across other matches."""

from tallywork.llm import pii

CASES = [
    ("Call 415-555-1234 or 415-555-9876 today.", "local_phone", ["415-555-1234", "415-555-9876"]),
    ("Either 415-555-1234 or 415-555-9876, my phone numbers.", "local_phone", ["415-555-1234", "415-555-9876"]),
    ("SSN: 123-45-6789, 987-65-4321, 111-22-3333 " + "z " * 30, "national_id", ["123-45-6789", "987-65-4321", "111-22-3333"]),
    ("SSN: " + ", ".join(["123-45-6789"] * 6), "national_id", ["123-45-6789"] * 3),  # the fourth lies 41 characters on
    ("Call " + "z" * 34 + " 415-555-1234", "local_phone", ["415-555-1234"]),
    ("Call " + "z" * 37 + " 415-555-1234", "local_phone", []),
]


def test_words_near_a_list(make):
    found = {r["doc_id"]: r["spans"] for r in pii.pii_spans(make([(i, c[0]) for i, c in enumerate(CASES)])).collect()}
    for i, (text, kind, want) in enumerate(CASES):
        assert [text[s["start"]: s["end"]].strip() for s in found[i] if s["kind"] == kind] == want, text


def test_context_is_the_text_around_each_match(make):
    words = {k.name: k.words for k in pii.KINDS}
    import re

    texts = [f"{w} {'12 ' * n}4111 1111 1111 1111, {'1.2.3.4 ' * n}a@b.co é😀 a@b.co {w}" for n in range(0, 16, 3) for w in ("card", "host", "mail")]
    for r in pii.pii_spans(make(list(enumerate(texts)))).collect():
        text = texts[r["doc_id"]]
        for s in r["spans"]:
            near = f"{text[max(0, s['start'] - 40): s['start']]} {text[s['end']: s['end'] + 40]}".lower()
            score = next(k.score for k in pii.KINDS if k.name == s["kind"]) + (0.3 if re.search(words[s["kind"]], near) else 0)
            assert abs(s["score"] - score) < 1e-9, (text, s)
