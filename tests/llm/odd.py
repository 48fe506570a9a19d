"""Awkward documents: nulls, empty and long texts, repeated rows, columns named like those the operators use inside."""

LONG = "Wort für Wort, ein Text 12 zum Zählen!  " * 2500
CLASHING = "digest int, node int, run int, slot int, lang_pred int, score int, keep_id int, piece int, token int, row int"
ODD = [(1, None, None), (2, "", "en"), (3, "  \n\t ", "en"), (None, "no id here at all", "en"), (5, "same text as the other", "en"), (6, "Same Text as the OTHER", "en"),
       (5, "same text as the other", "en"), (7, LONG, "de"), (8, "12345 !!", "de"), (9, "中文没有空格" * 400 + "😀" * 50, None), (10, "a", "en"), (11, "x" * 5000, None)]


def odd_documents(spark, rows=ODD):
    return spark.createDataFrame([(*r, *range(10)) for r in rows], "doc_id bigint, text string, lang string, " + CLASHING)
