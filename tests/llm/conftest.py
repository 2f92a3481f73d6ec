import pytest

pytest.importorskip("voxloom.llm")

LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empties, blanks, a very long text, repeats, and columns with clashing names."""
    rows = [
        (1, "Alpha beta gamma delta.", "en", "s", 3, "x", 1.0),
        (2, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "x", 2.0),
        (4, " \t\n ", "en", "s", 4, "x", 2.0),
        (5, LONG, "en", "s", 9, "x", 2.0),
        (1, "Alpha beta gamma delta.", "en", "s", 3, "x", 1.0),
        (6, "Alpha beta gamma delta.", "fr", "s", 3, "x", 1.0),
        (7, "日本語 テスト\n\n第二 行", "ja", "s", 3, "x", 1.0),
        (8, "one\x00two\r\nthree", None, "s", 3, "x", 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_runs string, score double")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.filter("doc_id < 0")
