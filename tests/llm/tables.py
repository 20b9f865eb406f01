"""Small frames for the tests of the operators for training data."""

from __future__ import annotations

TEXTS = [
    None, "", " \t\n ", "one", "The quick brown fox.\nThe quick brown fox.\n\nThe end",
    "a b c d e f g h a b c d e f g h i", "x " * 400, "é ñ 日本語 😀 " * 30, "word" * 5000,
    "#1 *two* $3 %4 &5 |6| <7>", "\x0b\x0cform\x0b feed\r\ntabs\tand spaces",
]


def documents(spark, texts=TEXTS, langs=("en", None, "de"), first=0):
    rows = [(first + at, text, langs[at % len(langs)], "src", "clash", 1.0) for at, text in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, words string, n_words double")


def by_id(frame):
    return {row["doc_id"]: row for row in frame.collect()}
