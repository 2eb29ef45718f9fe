import os
import random

import pytest

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet"))


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    long = prose(7, 60_000)
    copy = prose(8, 80)
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, copy), (6, copy), (7, copy + " end"), (7, copy + " end"), (8, long), (9, long + " tail"),
            (None, copy), (None, None), (10, "été \U0001f600 " * 30), (11, "a" * 50_000), (12, "\n\n  \t x  y z\n")]
    extra = ["score", "row", "segment", "ord", "part", "next", "copy", "sketch", "class_id", "n_words"]
    data = [(d, t, "x", None, *[i] * len(extra)) for i, (d, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in extra)
    return spark.createDataFrame(data, schema)
