import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = "n long, node long, key long, before long, rank long, score double, words string, tokens string, chunk long, part int, found string"


@pytest.fixture(scope="session")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text) pairs, with further columns in the way."""
    def make(*rows):
        df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
        return df.selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASH.split(", ")])
    return make


@pytest.fixture
def odd(docs):
    """Null ids and texts, empty, blank and very long texts, ties and rows that repeat."""
    long_ = " ".join(f"w{i % 997} x{i}" for i in range(60_000))
    return docs((1, "one two three four five six"), (None, "no id here at all"), (2, None), (3, ""), (4, " \n\t "), (5, long_), (5, long_), (6, "one two three four five six"), (7, "x"), (None, None), (8, "é" * 5000))
