import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, th string, size int, hits string, score string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source), with further columns whose names operators might use."""

    def build(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x", 1, "y", None) for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def words():
    draw = random.Random(5)
    return ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(4000)]


@pytest.fixture(scope="session")
def odd(make, words):
    """Null, empty, blank, very long, repeated rows and ties."""
    draw = random.Random(6)
    long = " ".join(draw.choice(words) for _ in range(60_000))
    line = " ".join(words[:40])
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "b"), (4, long, "en", "a"), (5, line, "en", "b"), (5, line, "en", "b"),
        (6, line, "de", "b"), (None, line, None, "a"), (None, None, None, None), (7, "é日本😀" * 30, "fr", "c"), (8, "one\ntwo\nthree\nfour", "en", "c"),
        (9, "one\ntwo\nthree\nfive", "en", "c"), (10, "x", "en", "a"),
    ]
    return make(rows)
