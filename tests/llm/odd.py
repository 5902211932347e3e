"""Rows that every operator on documents has to bear."""

LONG = "word " * 60_000 + "ünïcödé " * 2_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, start long, score double"


def documents(spark):
    """Nulls in each column, empty and very long texts, repeated rows, one id with two texts, columns with names used inside."""
    plain = "the quick brown fox jumps over the lazy dog and runs away from it all today"
    rows = [
        (1, plain, "en", "a", 10, "x", 1, 0.5),
        (1, plain, "en", "a", 10, "x", 1, 0.5),
        (2, None, "en", "a", None, None, None, None),
        (3, "", None, None, 0, "x", 2, 0.5),
        (4, " \t\n ", "en", "b", 4, "x", 2, 0.5),
        (None, plain + " again", "en", "b", 4, "x", 2, 0.5),
        (None, None, None, None, None, None, None, None),
        (5, LONG, "en", None, len(LONG), "x", 2, 0.5),
        (5, "another text under the same number", "fr", "c", 3, "x", 2, 0.5),
        (9_007_199_254_740_993, "12345 !!! ???", "en", "c", 3, "x", 2, 0.5),
        (7, "Ein ganz anderer Text \U0001f600 mit Zeichen\x00", "de", "c", 3, "x", 2, 0.5),
    ]
    return spark.createDataFrame(rows, SCHEMA)
