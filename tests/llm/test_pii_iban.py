"""IBANs with capitals, numbers or other IBANs right after them."""

from tallywork.llm import pii

CASES = [
    ("pay to DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
    ("DE89370400440532013000 I paid", ["DE89370400440532013000"]),
    ("DE89370400440532013000 500 EUR", ["DE89370400440532013000"]),
    ("GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00 NL91ABNA0417164300", ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NL91ABNA0417164300"]),
    ("AB12 INVOICE 2024 DE89 3704 0044 0532 0130 00.", ["DE89 3704 0044 0532 0130 00"]),
    ("DE89 3704 0044 0532 0130 01 BIC COBADEFF", []), ("xDE89370400440532013000", []), ("DE89370400440532013000x", []),
]


def test_ibans_in_bank_texts(make):
    found = {r["doc_id"]: r["spans"] for r in pii.pii_spans(make([(i, t) for i, (t, _) in enumerate(CASES)])).collect()}
    for i, (text, want) in enumerate(CASES):
        assert [text[s["start"]: s["end"]] for s in found[i] if s["kind"] == "iban"] == want, text


def test_each_country_once():
    lands = "|".join(pii.IBANS.values()).split("|")
    assert len(lands) == len(set(lands)) and all(15 <= n <= 34 for n in pii.IBANS)
