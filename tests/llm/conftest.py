import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, kept string"


@pytest.fixture(scope="session")
def prose():
    """Deterministic words: no two seeds share five of them in a row."""
    import random

    def make(seed: int, n: int) -> list[str]:
        r = random.Random(seed)
        return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def edge_docs(spark, prose):
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies and columns with clashing names."""
    base = prose(1, 120)
    near = base[:100] + ["changed"] + base[101:]
    passage = prose(2, 60)
    rows = [
        (1, " ".join(base), "en", "a"),
        (2, " ".join(base), "en", "a"),
        (3, " ".join(near), "en", "b"),
        (4, " ".join(base).upper(), None, "b"),
        (5, None, "en", "a"),
        (6, "", "en", None),
        (7, " \n\t ", "en", "a"),
        (8, "one two", "en", "a"),
        (9, "One  TWO", "en", "a"),
        (10, " ".join(prose(3, 6000)), "en", "a"),
        (11, "\n".join([" ".join(passage), " ".join(prose(4, 70))]), "en", "a"),
        (12, "\n".join([" ".join(prose(5, 70)), " ".join(passage)]), "en", "b"),
        (13, "x" * 5000, "en", "a"),
        (14, "a b c " * 200, "en", "a"),
        (15, "été ñandú 漢字 " * 30 + "end", "fr", "c"),
        (15, "été ñandú 漢字 " * 30 + "end", "fr", "c"),
        (None, " ".join(prose(6, 80)), "en", "c"),
        *[(20 + i, " ".join(prose(100 + i, 60)), "en", "a") for i in range(12)],
        *[(40 + i, " ".join(prose(200 + i, 60)) + " ### $$$", "en", "b") for i in range(4)],
    ]
    full = [(d, t, lang, s, None if t is None else len(t), "r", "w", "k") for d, t, lang, s in rows]
    return spark.createDataFrame(full, EDGE_SCHEMA).repartition(3, "source").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
