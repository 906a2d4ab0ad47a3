import pytest

#: Columns that operators might use themselves.
CLASHING = "digest bigint, score string, n_words string, slot string, label string, kept string, h string, __q int"
LONG = " ".join(f"wort{i % 977} tag{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "a plain text of some words that nobody else has written down yet " * 3, "en"),
        (1, "a plain text of some words that nobody else has written down yet " * 3, "en"),
        (1, "another text under the same id", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, " \n\t ", "de"),
        (None, "no id here but a text", "en"),
        (None, None, None),
        (None, "no id here but a text", "en"),
        (5, LONG, "de"),
        (6, "wort", "de"),
        (7, "\x00 � \U0001f600   <|endoftext|> ### | |", "xx"),
    ]
    full = [(*r, "src", None if r[1] is None else len(r[1]), 9, "s", None, "x", "y", "z", "q", 1) for r in rows]
    return spark.createDataFrame(
        full, f"doc_id bigint, text string, lang string, source string, n_chars int, {CLASHING}"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def tiny_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tiny_docs(spark, tiny_dir):
    return spark.read.parquet(f"{tiny_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(tiny_docs):
    return {r["doc_id"]: r["text"] for r in tiny_docs.collect()}
