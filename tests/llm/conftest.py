import pytest

NASTY = [(1, None), (2, ""), (3, " \t\n"), (3, " \t\n"), (None, "no id"), (None, None), (4, "Ünïcode ☃ 𝔘 text"), (5, "word " * 3000), (6, "The same text twice."), (7, "The same text twice."), (8, "<|endoftext|> x")]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in any column, empty and long texts, repeats, extra columns whose names clash with those inside operators."""
    rows = [(i, t, None if n % 3 == 0 else "en", "s", None, 1, "z", 0.5) for n, (i, t) in enumerate(NASTY)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, component string, score double")


@pytest.fixture(scope="session")
def documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")
