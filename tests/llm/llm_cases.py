"""Rows that every operator has to bear: nulls, empty and long texts, ties, repeats, columns whose names clash."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
ROWS = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, LONG, "en", "a", len(LONG)), (4, "one two three", None, "a", 13), (4, "one two three", None, "a", 13),
        (5, "one two three", "en", "b", 13), (None, "one two three", "en", "b", 13), (None, None, None, None, None), (6, " \n\t\n ", "en", "b", 5), (7, "Ünïcode ÀÉ text\n\nend\n", "fr", "b", 22)]
CLASHING = ("id", "row", "pos", "key", "h1", "n_lines", "n_dropped", "_id", "_text", "gone", "host", "keys", "rep", "root", "score", "kept", "n_words", "_row", "x", "line", "hi", "a")


def edge_docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHING))


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], SCHEMA)
