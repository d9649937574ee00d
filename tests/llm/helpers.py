"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema=DOCUMENTS, parts=2):
    """Rows of (doc_id, text) as a documents table."""
    return spark.createDataFrame([(d, t, "en", "src0", None if t is None else len(t)) for d, t in rows], schema).repartition(parts)


def awkward(spark, parts=2):
    """Nulls, empty and blank texts, repeated rows, a very long text, odd white space."""
    rows = [
        (1, "one two three four five six seven eight nine ten eleven"),
        (1, "one two three four five six seven eight nine ten eleven"),
        (2, None),
        (3, ""),
        (4, "   \n\t  "),
        (None, "a text without a number"),
        (5, "word " * 30_000),
        (6, "x" * 20_000),
        (7, "café été naïve  \U0001f600 <|endoftext|> <0x0A>\r\nnext\x0bline\x1cend ."),
        (8, " leading and trailing \n"),
    ]
    return documents(spark, rows, parts=parts)


def clashing(df, *names):
    """``df`` with more columns, named as an operator's own."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])
