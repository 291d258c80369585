import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, anchor string, _k int, bucket int"


@pytest.fixture
def docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, one very long text, columns with names the operators use."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(12_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.\nshort", "s1"), (2, "", "s1"), (3, None, "s2"), (4, " \n\t ", None),
        (5, long, "s2"), (6, "The quick brown fox jumps over the lazy dog near the river bank today.\nshort", "s1"),
        (6, "The quick brown fox jumps over the lazy dog near the river bank today.\nshort", "s1"), (None, "A text without a key stands here, all on its own.", "s3"),
        (8, "Ünïcödé 漢字 text 😀 with <|endoftext|> in it\r\nand a second line that is long enough", "s3"), (9, "x", "s3"),
    ]
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, s, len(t) if t else None, 7, "clash", 1, 2) for i, t, s in texts], DOCS)


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
