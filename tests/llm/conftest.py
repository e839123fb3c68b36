import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, shard int, draws string, digest string,"
    " class string, rep long, _range int, _copy boolean, _at int, _language string, _quality double, c string, words string"
)
LONG = " ".join(f"word{i * 7919 % 5000}" for i in range(120_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows that repeat, tie, lack values, or are very long; some differ in case or white space alone."""
    return [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (None, "a text without an id that nothing else has", "de", None),
        (4, LONG, "en", "a"),
        (5, " \n\t ", "fr", "c"),
        (6, "the quick brown fox jumps over the lazy dog again", "en", "b"),
        (7, "THE quick  brown fox\njumps over the lazy dog again", None, "b"),
        (8, "12 34 !! <|endoftext|> Σίσυφος ́eé \U0001f600 \x00   x", "el", "c"),
        (9, "one", "en", "a"),
        (-5, "two words", "de", "a"),
        (None, None, None, None),
        (4, "another text under the same id", "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """odd_rows as documents, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0, 1, 2, 3, "d", "g", "k", 4, 5, True, 6, "l", 0.5, "c", "w") for r in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, medium):
    return spark.read.parquet(f"{medium}/documents.parquet")
