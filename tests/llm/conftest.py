import pytest

LONG = "lorem ipsum dolor sit amet " * 8000
ODD = [  # (doc_id, text, source): nulls, empty, blank, long, repeated rows and ids
    (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, LONG, "b"), (5, "one two three", "b"),
    (5, "one two three", "b"), (5, "another text of the same id with more words than nine here", None),
    (None, "one two three", None), (None, None, None), (6, "Ünï çödé wörds and ASCII words in one line\nsecond line", "c"),
    (7, "x", "a\nb"), (8, "\n\n\n", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names clash with working names."""
    rows = [(i, t, s, "k", 7, True) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, word string, n long, hit boolean")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
