import random

import pytest
from pyspark.sql import functions as F


WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with NULLs in every column, empty, blank and very long texts, ties, repeated rows and odd columns."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    near = base.split()
    near[59] = "other"
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, " ".join(near), "de", "b"), (4, sentence(rng, 30), None, None),
        (5, "", "en", "a"), (6, None, "en", "b"), (7, " \t\n ", None, "c"), (8, sentence(rng, 20000), "fr", "c"),
        (9, "two words", "en", "a"), (10, "two  words", "en", "a"), (11, "Two words ", "en", None), (None, base, "en", "a"),
        (None, sentence(rng, 12), None, "a"), (12, "é É ñandú !!! $$$", "es", "b"), (12, "é É ñandú !!! $$$", "es", "b"),
        (13, "x", "en", "é"), (13, "another text under one key with more words", "en", "é"),
    ]
    rows += [(100 + i, sentence(rng, 25 + i % 40), "en", "hot" if i % 3 else "a") for i in range(60)]
    rows += [(300 + i, rows[20][1] + (" again" if i % 2 else ""), "en", "hot") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    # Names that operators use themselves.
    names = ("score", "size", "key", "kept", "row", "_row_hash", "doc", "n", "a.b")
    return df.select("*", F.length("text").cast("bigint").alias("n_chars"), *[F.lit(i).alias(c) for i, c in enumerate(names)]).cache()


@pytest.fixture(scope="session")
def rows(odd):
    return [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.filter("false")
