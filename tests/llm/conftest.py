import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, score double, spans string, _row long, h long, at int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and columns with clashing names."""
    long = "word salad and more of it " * 4000
    secret = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'
    texts = [None, "", "  \n ", "a", "Ünï çode 😀 text", long, secret, secret, "one two three four five six seven eight nine ten eleven twelve", None]
    rows = [(i if i < 8 else 3, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 2}", len(t or ""), 7, 8, 0.5, "x", 9, 10, 11) for i, t in enumerate(texts)]
    rows += [rows[8], (None, "no id at all", "de", "src1", 12, 7, 8, 0.5, "x", 9, 10, 11)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
