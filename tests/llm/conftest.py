import pytest

#: Documents with the cases that each operator must define: null, empty, long, tied and repeated rows, clashing names.
ROWS = [
    (1, "The mouse ran up the clock.\nThe clock struck one.\nDown it ran again.", "en", 1),
    (2, "The mouse ran up the clock.\nThe clock struck one.\nDown it ran again.", "en", 2),
    (2, "The mouse ran up the clock.\nThe clock struck one.\nDown it ran again.", "en", 2),
    (3, None, None, 3),
    (4, "", "en", 4),
    (5, "9876 --- 1234 !!!", "de", 5),
    (6, "wort " * 9000 + "ende", "de", 6),
    (None, "no id here", "en", 7),
    (8, "Ünïcödé ćhars — “quotes” 中文 текст 🙂 á", None, 8),
    (9, " \t\n\x0b\x0c\r ", "fr", 9),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(*r, "extra", 1.0) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, score string, fp double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
