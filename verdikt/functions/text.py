"""Tokens and lexical overlap as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores; none for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)), F.lower)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has. Both are token sets."""
    return F.size(F.array_intersect(query, text)) / F.greatest(F.lit(1), F.size(query))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def mean(x: Column) -> Column:
    """The mean, 0 of nothing."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))
