"""Predicates and three-valued logic as columns. A nullable boolean is a three-valued one, null is UNKNOWN."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_true(values: Sequence[Column]) -> Column:
    """AND; of nothing: true."""
    return reduce(lambda a, b: a & b, values) if values else F.lit(True)


def any_true(values: Sequence[Column]) -> Column:
    """OR; of nothing: false."""
    return reduce(lambda a, b: a | b, values) if values else F.lit(False)


def negated(values: Sequence[Column]) -> Column:
    """NOT of the first; of nothing: unknown."""
    return ~values[0] if values else F.lit(None).cast("boolean")


def tri(value: Column) -> Column:
    """TRUE, FALSE or UNKNOWN."""
    return F.when(value.isNull(), "UNKNOWN").when(value, "TRUE").otherwise("FALSE")


def every(value: Column) -> Column:
    """AND of a group's rows; Spark's bool_and passes nulls over."""
    return F.when(F.coalesce(F.bool_or(~value), F.lit(False)), False).when(F.count("*") == F.count(value), True)


@dataclass(frozen=True)
class Operand:
    """A side of a predicate: its column, whether that is known, and what it holds."""

    value: Column
    known: Column
    base: str = "string"
    kind: str = "scalar"  # or set, list

    @property
    def many(self) -> bool:
        return self.kind != "scalar"

    @property
    def as_set(self) -> Column:
        return F.array_distinct(self.full) if self.many else F.array(self.value)

    @property
    def full(self) -> Column:
        """A container, where null stands for none."""
        return F.coalesce(self.value, F.array().cast(f"array<{SPARK_BASE[self.base]}>"))

    @property
    def text(self) -> Column:
        """As it prints: None, True, and sets in braces in order."""
        if self.many:
            inner = F.array_join(F.sort_array(self.as_set) if self.kind == "set" else self.full, ", ", "None")
            return F.concat(F.lit("{" if self.kind == "set" else "["), inner, F.lit("}" if self.kind == "set" else "]"))
        shown = F.when(self.value, "True").otherwise("False") if self.base == "bool" else self.value.cast("string")
        return F.coalesce(F.when(self.value.isNotNull(), shown), F.lit("None"))


SPARK_BASE = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string"}
_NUMBERS = {"int", "float"}


def comparable(a: Operand, b: Operand) -> bool:
    return a.base == b.base or {a.base, b.base} == _NUMBERS


def _equal(a: Operand, b: Operand) -> Column:
    if a.many != b.many or (a.many and a.kind != b.kind):
        return F.lit(False)
    if a.kind == "set":
        return (F.size(F.array_except(a.full, b.full)) == 0) & (F.size(F.array_except(b.full, a.full)) == 0) if comparable(a, b) else (F.size(a.full) == 0) & (F.size(b.full) == 0)
    if not comparable(a, b):
        return (F.size(a.full) == 0) & (F.size(b.full) == 0) if a.many else a.value.isNull() & b.value.isNull()
    return a.full == b.full if a.many else a.value.eqNullSafe(b.value)


def _common(a: Operand, b: Operand) -> Column:
    """How many distinct members two operands share, each taken as a set; nulls are members like others."""
    if not comparable(a, b):
        return F.when(F.array_contains(F.transform(a.as_set, lambda x: x.isNull()), True) & F.array_contains(F.transform(b.as_set, lambda x: x.isNull()), True), 1).otherwise(0)
    return F.size(F.array_intersect(a.as_set, b.as_set))


def _within(a: Operand, b: Operand) -> Column:
    """Whether all of a's members are b's."""
    return _common(a, b) == F.size(F.array_distinct(a.as_set))


def _less(a: Operand, b: Operand, or_equal: bool, strict: bool = False) -> Column:
    """Numbers and strings by order, sets by inclusion; what can't be ordered is unknown, or an error if strict."""
    if a.many != b.many or a.kind != b.kind or not comparable(a, b):
        return (F.raise_error(F.lit(f"{a.kind} of {a.base} and {b.kind} of {b.base} have no order")) if strict else F.lit(None)).cast("boolean")
    if a.kind == "set":
        return _within(a, b) if or_equal else _within(a, b) & (F.size(a.as_set) < F.size(b.as_set))
    left, right = (a.full, b.full) if a.many else (a.value, b.value)
    ordered = left <= right if or_equal else left < right
    return F.when(left.isNull() | right.isNull(), F.raise_error(F.lit("nothing has no order")).cast("boolean")).otherwise(ordered) if strict else ordered


def compare(op: str, a: Operand, b: Operand, strict: bool = False) -> Column:
    """The predicate's value; unknown if an operand is, or the operator is none. Membership takes containers as sets,
    a scalar as a set of one (also of a null). strict: known values that can't be ordered are an error."""
    tests = {
        "EQ": lambda: _equal(a, b),
        "NEQ": lambda: ~_equal(a, b),
        "IN": lambda: _common(a, b) > 0,
        "NIN": lambda: _common(a, b) == 0,
        "CONTAINS": lambda: _within(b, a),
        "SUPERSET": lambda: _within(b, a),
        "LT": lambda: _less(a, b, False, strict),
        "LE": lambda: _less(a, b, True, strict),
        "GT": lambda: _less(b, a, False, strict),
        "GE": lambda: _less(b, a, True, strict),
        "MATCH": lambda: F.contains(a.text, b.text),
    }
    if op.upper() not in tests:
        return F.lit(None).cast("boolean")
    return F.when(a.known & b.known, tests[op.upper()]())
