import pytest


@pytest.fixture(scope="session")
def texts(spark):
    """Odd documents with an extra column whose name clashes with the operators' own."""
    long = " ".join(f"word{k % 977} and" for k in range(30_000))
    line = "This very common line is long enough to be a key of its own."
    rows = [
        (0, None, "a", 1), (1, "", "a", 1), (2, "one", None, 1), (3, long, "b", 1), (4, long, "b", 1), (4, long, "b", 1), (None, "a row without an id, " * 20, "c", 1),
        (5, "Mail a@b.co now or call +1 (532) 555-7857, card 4111 1111 1111 1111.", None, 1), (6, "x" * 5000, "c", 1), (7, " \t\n ", "b", 1),
    ] + [(10 + k, f"{line}\nA text of its own with number {k} and some more words here {k * 7}.\n{line.upper()}", "abc"[k % 3], 1) for k in range(8)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, quality int")


@pytest.fixture(scope="session")
def empty(texts):
    return texts.where("false")
