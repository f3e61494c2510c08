"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog while ten wise owls watch from old oak trees by night " * 400


def odd_rows():
    base = [f"w{i}" for i in range(60)]
    near = list(base)
    near[30] = "changed"
    return [
        (1, " ".join(base), "en", "a", 1),
        (2, " ".join(near), "en", "a", 1),
        (3, " ".join(base).upper(), "en", "a", 1),
        (3, " ".join(base).upper(), "en", "a", 1),
        (4, None, "en", "a", 1),
        (5, "", None, None, None),
        (6, " \n\t ", "en", "b", 1),
        (7, "one two three", "en", "b", 1),
        (8, "One  two\tthree", "en", "b", 1),
        (9, LONG, "en", "b", 1),
        (None, "no id at all " * 30, "en", "b", 1),
        (None, None, None, None, None),
        (10, "x" * 50_000, "en", "b", 1),
        (11, "é ß ñ 漢字 \U0001f600 İ Σ", "fr", "c", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with extra columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    for name in ("n", "f1", "h1", "key", "g", "held", "queue", "part", "row", "c", "comp", "score", "y", "votes", "_id", "_row"):
        odd = odd.withColumn(name, F.lit("clash"))
    return odd


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))
