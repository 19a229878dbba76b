from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, source string, row long, label_id long, words string"


def prose(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Rows with nulls, blanks, repeats, ties, clashing extra columns and a very long text."""
    rng = random.Random(3)
    base, other = prose(rng, 300), prose(rng, 280)
    near = base.replace(" w1", " W1x", 2)
    long = prose(rng, 60_000, 30_000)
    texts = [
        (1, base), (2, base.upper()), (3, near), (4, None), (5, ""), (6, "   \n "), (7, "one two"), (8, other), (9, other + " tail"),
        (10, long), (11, "é" * 700), (12, base), (12, base), (None, other), (None, None), (13, "x" * 1200), (14, prose(rng, 40) + " " + base[:800]),
        (15, "<|endoftext|> ünï 　 \t tab"), (16, "a b c d"), (17, "a b c d e f g h"),
    ]
    return [(i, t, "s", 5, 6, "w") for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
