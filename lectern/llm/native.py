"""Column helpers for the operators that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once even if ``body`` is a loop that names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for null.

    Blanks become single characters first: a split at one plain character needs no regular expression.
    """
    rare = [F.contains(text, F.lit(x)) for x in "\t\x0b\x0c\r"]
    flat = F.when(rare[0] | rare[1] | rare[2] | rare[3], F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text)
    return F.coalesce(F.array_remove(F.split(F.replace(flat, F.lit("\n"), F.lit(" ")), " "), ""), F.array().cast("array<string>"))


def total(values: Column) -> Column:
    """Sum of an array of longs."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
