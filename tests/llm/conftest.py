import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fingerprint string, n_tokens string"
LONG = "the quick brown fox jumps over the lazy dog and then it goes home again to sleep "


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    rows = [(i, f"{LONG}{i % 7}\nund der hund läuft nach hause {i}\nA {i} b", ("en", "de")[i % 2], f"s{i % 3}", 1) for i in range(40)]
    rows += [(50, None, "en", "s1", None), (51, "", None, None, 0), (52, " \t\n", "de", "s0", 3), (None, "no id here at all", "en", "s0", 5), (None, None, None, None, None)]
    rows += [(53, "12 34 !!", "en", "s2", 8), (54, LONG * 3000, "en", "s0", 9), (55, "ÄÖÜ ß é 漢字 x", "de", "s2", 4), (56, "one", "en", "s1", 3), (3, f"{LONG}3\nund der hund läuft nach hause 3\nA 3 b", "de", "s0", 1)]
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
