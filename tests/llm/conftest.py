import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls, empty and long texts, copies and repeated rows, and columns whose names clash with results."""
    long = " ".join(f"w{i % 997}x{i // 997}" for i in range(6000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, "  \n\t ", "de", "b", 5), (3, long, "en", "a", 1), (4, f"start {passage} end one two", "en", "a", 1),
        (5, f"{passage}", "fr", None, 1), (6, f"other {passage} tail\n{passage}", None, "c", 1), (7, "short text here", "en", "a", 1), (7, "short text here", "en", "a", 1),
        (8, "Short  TEXT\there", "en", "a", 1), (9, "a b c d e f g h " * 12, "en", "b", 1), (None, "row without id but with words", "en", "b", 1), (10, "été à l'école ▁ 😀", "fr", "b", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long")


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("doc_id < 0")
