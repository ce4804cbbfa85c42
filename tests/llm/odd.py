"""Small tables with everything that a row may hold."""

from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


SECRET = "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
TEXTS = [
    (1, ""),
    (2, None),
    (None, "The row without an id has text. It has two sentences."),
    (3, "one two three"),
    (3, "one two three"),
    (4, "the same words stand here in both rows and in the next one as well"),
    (5, "the same words stand here in both rows and in the next one as well"),
    (6, "THE same words stand here in both rows and in the next one as well."),
    (7, f"é {SECRET} end"),
    (8, "word " * 30_000 + "x" * 5_000),
    (9, " \t\n  　\x85 "),
    (10, "日本語 🙂 ünïcode\x1c <|endoftext|> 'LL it's"),
    (11, "Released under the MIT License. " * 3 + "Apache License, Version 2.0; CC BY-NC-SA 4.0"),
    (None, None),
]


def odd_documents(spark, *clashing):
    """Rows with nulls, empty and long texts, ties and repeats; columns whose names are used inside."""
    docs = frame(spark, TEXTS).withColumn("lang", F.lit(None).cast("string"))
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    for name in clashing:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs
