import pytest


#: Rows with nulls in any column, empty, blank and long texts, ties and repeats.
ROWS = [
    (1, "The cat sat on the mat. The cat sat.\nA second line here", "en", "a"),
    (2, "The cat sat on the mat. The cat sat.\nA second line here", "en", "a"),
    (2, "The cat sat on the mat. The cat sat.\nA second line here", "en", "a"),
    (3, "", None, "b"), (4, None, "en", None), (None, "no id here at all", "en", "b"), (5, "  \n\n \t", "fr", "b"),
    (6, "le chat est sur la table et le chien est dans la maison", "fr", None),
    (7, "long " * 6000 + "end", "en", "c"), (8, "1234 5678 !!", "en", "c"), (9, "<|endoftext|> </turn> \\l <b>", None, "c"),
]


@pytest.fixture()
def docs(spark):
    rows = [(i, t, la, s, len(t or ""), 0.5, "x") for i, t, la, s in ROWS]
    # names that clash with the operators' own columns
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, piece string")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
