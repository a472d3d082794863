import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, letters="aeioustrnl"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and blank texts, repeated rows, ties, one very long text."""
    rng = random.Random(1)
    long = "\n".join(prose(rng, 50) for _ in range(2000))
    base = prose(rng, 120)
    return [
        (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \n\t ", None, None, 4), (4, base, "en", "s", 1), (4, base, "en", "s", 1), (5, base, None, "s", 1),
        (None, base, "en", "s", 1), (None, "only here " * 3, "en", "s", 1), (6, long, "en", "s", len(long)), (7, "word", "en", "s", 4), (8, "Ünïcode ß 漢字 text 😀 <|endoftext|> x", "de", "s", 1), (9, "123 456", "en", "s", 7),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, *names):
    """The same rows with extra columns that have names an operator uses itself."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("taken") for n in names if n not in df.columns})
