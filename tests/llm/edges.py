"""Rows that every document operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "Die Katze sitzt auf der Matte und sieht den Hund. Licensed under the Apache License.", "de", "a", 80),
    (2, "Die Katze sitzt auf der Matte und sieht den Hund. Licensed under the Apache License.", "de", "a", 80),
    (2, "Die Katze sitzt auf der Matte und sieht den Hund. Licensed under the Apache License.", "de", "a", 80),
    (3, None, "de", None, None),
    (4, "", None, "a", 0),
    (5, " \n\t ", None, None, None),
    (6, "12345 !!! 678", "en", "a", 13),
    (7, "the quick brown fox jumps over the lazy dog again and again " * 3000, "en", "b", 1),
    (8, "one", "en", "b", 3),
    (9, "ONE", None, None, 3),
    (10, "Été \U0001f600 naïve 中文 café", "fr", None, None),
    (None, "a row without an id", "en", "b", 1),
    (11, "<|endoftext|> </s>[INST] x", "en", "b", 1),
]


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, DOCS)


def clashing(df):
    """The same rows with columns named like the operators' own."""
    for c in ("score", "kept", "keep_id", "n_words", "hash", "value", "n", "labels", "digest", "piece", "size", "id", "component_id", "pos", "run", "word"):
        df = df.withColumn(c, F.lit("x"))
    return df


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def check_edges(spark, operator, one_row_per_document=True):
    """operator(docs) on ordinary, clashing and empty tables."""
    docs = documents(spark)
    out = operator(docs)
    rows = out.collect()
    if one_row_per_document:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert sorted(map(repr, rows)) == sorted(map(repr, operator(clashing(docs)).select(*out.columns).collect()))
    assert operator(documents(spark, [])).count() == 0
    return rows
