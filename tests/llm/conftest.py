from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    stock = ["the", "and", "of"] * 25 + ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(300)]
    return " ".join(r.choice(stock) for _ in range(n))


def corpus() -> list[tuple]:
    """Nulls, empties, blanks, one very long text, near and exact copies, repeated lines, a repeated row, a hot source."""
    base = prose(1, 120)
    words = base.split()
    near = [" ".join(w if k != 10 + i else "changed" for k, w in enumerate(words)) for i in range(6)]
    texts = [None, "", " \t\n ", "a b c", base, base, *near, prose(2, 4000), "line one here\nline two here\nline one here\n" * 4, prose(3, 60) + " " + base, "É ß　x " * 30]
    rows = [(i, t, "en", None if i % 7 == 3 else f"src{0 if i % 3 else i}", len(t or ""), "clash") for i, t in enumerate(texts)]
    return [*rows, rows[4]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)
