import pytest

#: Nulls, empty and blank texts, repeated ids and rows, one very long text, and columns whose names the operators use too.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, start string, kept string, rank int, hash string"


def odd_rows():
    long_text = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "a"),
        (2, "Alpha beta GAMMA delta epsilon zeta eta theta", "a"),
        (3, None, None),
        (4, "", "b"),
        (5, " \t\n ", "b"),
        (6, "one two", "b"),
        (6, "one two", "b"),
        (6, "three four five", "c"),
        (None, "no id here", None),
        (None, None, None),
        (7, long_text, "c"),
        (8, "a" * 5000, "c"),
        (9, "é🎉 ▁ x  y\n\nmail me: a.b@c.de or +1 (988) 555-2485", "c"),
    ]
    return [(i, t, "en", s, len(t or ""), 5, "x", "y", "z", 1, "h") for i, t, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
