"""Types of values in tables: literals as columns, and the type that holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_int(text: Column) -> Column:
    return text.rlike(r"^-?[0-9]+$")


def is_number(text: Column) -> Column:
    return text.rlike(r"^-?[0-9]+(\.[0-9]+)?$")


def is_bool(text: Column) -> Column:
    return F.lower(text).isin("true", "false")


def parse_set(text: Column) -> Column:
    """The members of {a b} or {a,b}, distinct and in order."""
    inner = F.regexp_replace(F.trim(text), r"^\{|\}$", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(inner, r"[\s,]+"), lambda x: x != "")))


def infer_datatypes(rows: DataFrame, *columns: str) -> DataFrame:
    """For each group of all columns but the last: datatype of the last's texts (int, float, bool, string, or set[...] if
    any is in braces) and n. Nulls are no values; a group without any is string."""
    *by, value = columns
    x = F.col(value)
    braced = x.rlike(r"^\s*\{.*\}\s*$")
    items = F.when(braced, parse_set(x)).otherwise(F.array(x))
    every = lambda test: F.coalesce(F.bool_and(F.forall(items, test)), F.lit(False))
    base = F.when(every(is_int), "int").when(every(is_number), "float").when(every(is_bool), "bool").otherwise("string")
    whole = F.when(F.coalesce(F.bool_or(braced), F.lit(False)), F.concat(F.lit("set["), base, F.lit("]"))).otherwise(base)
    return rows.groupBy(*by).agg(whole.alias("datatype"), F.count(x).alias("n"))
