import pytest

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, "The quick brown fox jumps over the lazy dog. " * 12),
    (7, "The quick brown fox jumps over the lazy dog. " * 12), (8, "ça é ñ ü ß 日本語 😀"), (9, "a" * 50_000), (10, "w " * 20_000), (11, "12345 " * 30),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, short, equal, very long texts, and columns whose names clash with those inside the operators."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", len(t) if t is not None else None, "x", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, n double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id < 0")
