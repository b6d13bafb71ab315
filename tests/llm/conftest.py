import pytest

LONG = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do. " * 900


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, empty and long texts, ties, repeats and
    extra columns whose names the operators use inside."""
    rows = [
        (1, "One two three four five six seven. one two three", "en", "b"), (2, "One  two three four five\nsix seven. one two three", "en", "b"),
        (2, "One  two three four five\nsix seven. one two three", "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n", "en", "c"), (None, "no id here", "de", None),
        (7, LONG, "en", "a"), (8, LONG + "x", "en", "a"), (9, "größe 漢字 🙂 İstanbul <|endoftext|> ΣΑΣ don't", "de", "b"), (10, "a" * 5000, None, "c"), (11, "word", "en", "b"),
        (12, "mail me: a.b@x.example.com or +1 (555) 010-9999, 10.0.0.255 and 4111 1111 1111 1111!", "en", "a"),
    ]
    more = [(*r, 0, "t", 1, 2.0, "k", "g", 3, 4) for r in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, len int, digest string, id int, score double, key string, fp string, size int, row int").repartition(3)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (7, None, None), (8, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
