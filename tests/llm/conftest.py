import pytest

#: Rows that every operator has to stand: nulls, empty and blank texts, repeats, ties, a very long text and a long word.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (5, "a b c"), (5, "a b c"), (6, "word " * 5000), (7, "x" * 30_000),
         (8, "Émile's café costs 12 € \u00a0 и ещё 漢字 🙂"), (None, "no id here at all"), (None, None), (9, "a b c d e f g h i j k l m n o p q r s t u v"),
         (10, "zz a b c d e f g h i j k l m n o p q r s t u v yy")]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """With extra columns that are called like the operators' own."""
    rows = [(i, t, "en", "s", 0, 1.5, "x", "y", 7, "z") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, "
                                       "`_own` string, `_found` string, n int, `_hit` string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
