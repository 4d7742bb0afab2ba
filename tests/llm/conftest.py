import random

import pytest

WORDS = ["the", "and", "house", "river", "stone", "walks", "under", "blue", "tree", "old", "night", "song", "wind", "far", "road", "Émile", "maison", "über", "straße", "niño"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, h string, cls long, size long, kept_id long, target double, label string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.4 else "") for _ in range(n)) + "."


@pytest.fixture(scope="session")
def awkward():
    """Rows with nulls, empty, blank, very short and very long texts, repeats, near copies, odd white space."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    words = base.split()
    texts = [None, "", " \n\t", "One", "one", "a b c d", "A B C D", "x " * 12, base, base, base.upper(), " ".join([*words[:55], "changed", *words[56:]]), " ".join(words[:50]), "\x0b".join(words), "café " * 3, "12345 !!!", sentence(rng, 30000)]
    texts += [sentence(rng, rng.randrange(1, 80)) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), len(t or ""), 0.5, 1, "h", 1, 1, 1, 1.0, "x") for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, base, "en", "a", 1, 0.5, 1, "h", 1, 1, 1, 1.0, "x"), (-7, texts[20], None, None, 1, 0.5, 1, "h", 1, 1, 1, 1.0, "x")]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
