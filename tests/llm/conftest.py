import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    """Hard cases: nulls, empty and long texts, repeated rows, near copies, odd white space, extra columns with clashing names."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(6000))
    base = " ".join(f"tok{i}" for i in range(60))
    near = base.replace("tok30", "other")
    rows = [
        (1, base, "a"), (2, base, "a"), (3, near, "b"), (4, base + " ", None), (5, "", "b"), (6, None, "c"), (7, long, "a"), (8, long + " tail", "a"),
        (9, "Shared line of text here\nown one\n\n  SHARED line of text here  ", "b"), (10, "shared line of text here\nanother\nshort", "c"), (11, "short\nshort", "c"),
        (12, "mail bob.7@mail.example.com or +1 (523) 555-1055 at 10.1.2.3 card 4111 1111 1111 1111 9", "a"), (None, "null id text with a few words", "b"), (13, base, "a"), (13, base, "a"),
        (14, "é  two  spaces\n \n and\ttabs   nbsp", "b"), (15, "   ", "a"), (16, "one", None),
    ]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"kept": F.lit(True), "_len": F.lit(1), "n_lines": F.lit(7), "keep": F.lit(1), "votes": F.lit("x")}).persist()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
