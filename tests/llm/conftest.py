import random

import pytest

from staylens.llm.common import Stored

# names that operators use inside
EXTRA = ["block", "kind", "t", "name", "digest", "rep", "key", "part", "shared", "copy", "found", "sig", "n", "ids", "peek"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src", None if text is None else len(text), *["x"] * len(EXTRA))


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows of (doc_id, text[, lang])) -> documents with extra columns of clashing names."""
    def make(rows):
        return spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(3)
    base, other = words(rng, 300), words(rng, 200)
    near = base.split()
    near[150] = "changed"
    long = words(rng, 30_000)
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, other + " " + base[:700]), (5, None), (6, ""), (7, " \n\t "),
        (8, "one"), (9, "one"), (10, "é日本 \U0001f600 ß"), (11, long), (12, long + " tail"), (13, "12345 !!! 67"),
        (14, "same row"), (14, "same row"), (None, base), (None, None), (15, "word " * 400), (16, "x\x00y  z\n\nw "),
        (17, other, None), (18, "mail a.b@c.example.org or +1 (212) 555-0123, 10.0.0.1", "de"),
    ]


@pytest.fixture(scope="session")
def edges(frame, edge_rows):
    return frame(edge_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(frame):
    return frame([])


@pytest.fixture()
def store(spark):
    return Stored(spark, "test")
