import random

import pytest

CLASHING = ["score", "size", "start", "n", "target", "k_id", "root", "h"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, wordless and very long texts, repeated rows, and columns that clash with the operators' own."""
    r = random.Random(1)
    rows = [
        (1, words(r, 60), "en", "a", 0),
        (2, None, "en", "a", 0),
        (3, "", None, None, None),
        (4, " \t\n !!! ***", "en", None, 1),
        (5, words(r, 60_000), "de", "b", 2),
        (6, "same words here for all", "de", "b", 2),
        (6, "same words here for all", "de", "b", 2),
        (7, "Same words, here for ALL!", "fr", "c", 2),
        (None, "a text without an id", "fr", "c", 2),
        (8, "naïve café \x00 zero \U0001f600 ẞ İstanbul's <|endoftext|> 123", "fr", "", 2),
    ]
    extra = [tuple(range(len(CLASHING)))] * len(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame([a + b for a, b in zip(rows, extra, strict=True)], schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    """The labels of the next size, so that a held-out part is there to judge by."""
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def more_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
