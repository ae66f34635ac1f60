from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lines int, row string, _d long"


def prose(rng: random.Random, n: int) -> str:
    words = "river stone cloud winter garden letter window silver forest morning candle harbour mountain shadow bridge engine paper copper valley market".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ed", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and blank texts, copies, near copies, a long text, repeated rows, null ids and sources, accents."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(40)]
    long = "\n".join(prose(rng, 50) for _ in range(150))
    near = [" ".join(w if i != k else "changed" for i, w in enumerate(prose(random.Random(9), 300).split())) for k in range(0, 300, 15)]
    rows = [None, "", " \t\n ", "é à ü", "one", "one two three", long, long + " tail", *base, *base[:5], base[0].replace(" ", "  "), *near, *["hot copy of a text that many share. It goes on for a while and repeats itself."] * 60]
    out = [(k, t, ["en", "fr", None][k % 3], ["a", "b", None, "é"][k % 4], 0, 1, "x", 5) for k, t in enumerate(rows)]
    return [*out, out[10], out[10], (None, "no id", "en", "a", 0, 1, "x", 5), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
