from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


def make_texts() -> list[str | None]:
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvwéß") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = prose(120), prose(60)
    near = base.split()
    near[50] = "changed"
    texts: list[str | None] = [None, "", " \n\t ", "word", "One two  THREE", "a" * 700, base, base, " ".join(near), base.upper(), prose(30) + " " + passage + " " + prose(40), prose(50) + "\n" + passage, passage]
    texts += [prose(n) for n in (5, 6, 17, 80, 200, 900)]
    return texts + ["Ünï <|endoftext|> it's 12 ½ 𝒳!", prose(3000)]


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Odd texts, extra columns whose names clash with added ones, and one repeated row."""
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", None, 1.0, "k") for i, t in enumerate(texts)]
    rows.append(rows[6])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
