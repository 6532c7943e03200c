from __future__ import annotations

import pytest

LONG = "seven words make up this long text " * 8000
NEAR = [f"w{i}" for i in range(200)]


def documents():
    """Null ids, texts and sources, empty and long texts, ties and repeated rows, with columns whose names clash."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog. It ran away.", "a"),
        (2, "The quick brown fox jumps over the lazy dog. It ran away.", "a"),
        (3, "", "a"),
        (4, None, None),
        (5, "   \n\t ", "b"),
        (6, LONG, "b"),
        (7, " ".join(NEAR), "b"),
        (8, " ".join([*NEAR[:199], "other"]), "b"),
        (9, " ".join([*NEAR[:100], *(f"x{i}" for i in range(100))]), "c"),
        (10, "two words", "c"),
        (11, "TWO words", "c"),
        (12, "Grüße aus Köln – 日本語 😀 café", "c"),
        (13, "password = hunter2hunter2 mail me at a.b@c.example +49 (30) 1234567", "c"),
        (13, "password = hunter2hunter2 mail me at a.b@c.example +49 (30) 1234567", "c"),
        (None, "no id at all", "c"),
        (None, None, "c"),
        (15, "<|endoftext|> is ordinary text here", "c"),
    ]
    more = ("x", "y", 1, 2)
    return [(i, t, "en", s, None if t is None else len(t), *more) for i, t, s in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, key string, rep int, _id int"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
