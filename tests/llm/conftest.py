import random

import pytest

CLASHING = ["id", "tag", "pos", "line", "key", "hash", "node", "n", "row", "keep", "score", "block"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names operators might use themselves."""

    def build(rows):
        extra = ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(i, t, *["x"] * len(CLASHING)) for i, t in rows], f"doc_id long, text string, {extra}")

    return build


@pytest.fixture(scope="session")
def prose():
    """A text of some words, the same for the same seed."""

    def build(seed, n=60, marks=True):
        draw = random.Random(seed)
        words = ["".join(draw.choice(("an", "the", "ti", "é", "on", "re", "Sh", "ß", "ing")) for _ in range(draw.randint(1, 4))) for _ in range(n)]
        return " ".join(w + ("." if marks and draw.random() < 0.1 else ",\n" if marks and draw.random() < 0.05 else "") for w in words)

    return build


@pytest.fixture(scope="session")
def cases(prose):
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(prose(s, 400) for s in range(12))
    odd = "a\xa0b  c\t\n d <|endoftext|>x <|ENDOFTEXT|> don't 12,5... \u3000end "
    rows = [(5, prose(1)), (1, prose(2)), (2, prose(2)), (3, ""), (4, None), (6, long), (7, odd), (8, " \n\n "), (None, prose(1)), (9, prose(3)), (9, prose(3))]
    return rows + [(20 + i, prose(50 + i, 30) + "\n" + "the same line everywhere") for i in range(8)]
