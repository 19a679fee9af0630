import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Awkward rows: nulls in every column, empty and long texts, repeats, ties, extra columns with clashing names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    base = " ".join(words[i % 12] + str(i) for i in range(80))
    edited = base.replace("beta1 ", "changed ", 1)
    rows = [
        (1, base, "en", "a"),
        (2, edited, "en", "a"),
        (3, base, "en", "b"),
        (4, None, "en", "b"),
        (5, "", "en", None),
        (6, "  \n\t ", None, "a"),
        (7, "one two", "fr", "a"),
        (8, "One TWO", "fr", "c"),
        (None, "no id here at all", "fr", "c"),
        (9, "x" * 300_000 + " " + "long words here " * 40_000, "de", "c"),
        (10, "unique text number ten", "de", "c"),
        (10, "unique text number ten", "de", "c"),
        (11, "12345 6789 !!!", "de", "c"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    extra = "name string, score double, rejected string, size int, hash int, row int, part int, copies int, u int, text_hash int"
    df = spark.createDataFrame([(*r, "n", 0.5, "r", 1, 2, 3, 4, 5, 6, 7) for r in rows], f"{schema}, {extra}")
    return df
