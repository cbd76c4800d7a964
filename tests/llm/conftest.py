import random

import pytest

from tests.conftest import DATA

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, kept string, size string, place string, core string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table, with columns whose names the operators use inside, from (doc_id, text[, lang, source])."""
    def build(rows):
        full = [(*r, "en", "s")[:2] + tuple(r[2:] or ("en", "s")) + (len(r[1] or ""), "a", "b", "c", "d", "e") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) of the smallest documents table."""
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    random.seed(5)
    passage = " ".join(random.choices("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split(), k=120))
    long = "\n".join(" ".join(random.choices("alpha beta gamma delta epsilon zeta".split(), k=9)) for _ in range(2500))
    return [
        (1, None, None, None), (2, "", "en", None), (3, " \t\n", None, "s"), (4, "one"), (5, "o ne\n"), (6, "one  "),
        (7, passage), (8, passage), (9, "before " + passage + " after"), (10, long), (11, long + " end"), (12, "x" * 5000),
        (13, "héllo wörld 😀 " * 80), (14, "a\nb\nc\nd\na\nb\nc\n"), (15, "\n\nb\n c \nd\n"), (16, passage.upper()),
    ]
