"""Documents with every kind of trouble, and extra columns whose names clash with those used inside."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{k % 977}x{k % 1009}" for k in range(30_000))


def documents(spark, rows):
    """Rows of (doc_id, text) or whole rows."""
    full = [r if len(r) == 5 else (*r, "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    prose = " ".join(f"tok{k}" for k in range(80))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, LONG, "en", "a", len(LONG)),
        (5, prose, "en", "a", 1),
        (5, prose, "en", "a", 1),
        (6, prose, None, None, None),
        (None, prose + " end", "en", "b", None),
        (None, None, None, None, None),
        (7, "one two", "de", "b", 7),
        (8, "naïve 漢字 😀 ퟿</s> <|end|> \\ [INST]", "de", "b", 5),
    ]
    return spark.createDataFrame(rows, DOCS)


CLASHES = ("__row", "__text", "__host", "__part", "__nth", "__gone", "__words", "rule_stats", "kept", "row", "key", "root", "block", "a.b")


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
