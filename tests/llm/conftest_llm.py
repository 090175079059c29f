"""Small tables with the awkward cases every operator must take."""

import pytest

AWKWARD = [
    (1, "A plain sentence of ordinary words that goes on for a while and then ends here.", "en", "web"),
    (1, "A plain sentence of ordinary words that goes on for a while and then ends here.", "en", "web"),
    (2, None, None, None),
    (3, "", "en", "web"),
    (4, " \t\n\x0b\x0c\r ", "xx", ""),
    (None, "one two", "de", None),
    (5, "x" * 70_000, "en", "web"),
    (6, "word " * 30_000, "fr", "books"),
    (7, "Ünï cödé ￿ \U0001f600 text", "other", "books"),
    (8, None, "en", "web"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, component_id string, size string, kept string, score string, spans string, _text string, n_shingles string, target string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(*r, *["other"] * 9) for r in AWKWARD], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


def docs_of(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


@pytest.fixture(scope="session")
def prose():
    """Random prose: the words of a few hundred syllable pairs."""
    import random

    rng = random.Random(7)
    vocabulary = [a + b for a in "ka lo mi ne ru sa ti vo".split() for b in "bar den fil gos han".split()]
    return lambda n, seed=None: " ".join((random.Random(seed) if seed is not None else rng).choices(vocabulary, k=n))
