"""Sets of each key's values, as collect_set gives them, where the values are few: bits of whole numbers, which aggregate without objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of a column that are bits at most, 64 a number.
MOST = 256


class Values:
    """A column's values, which are bits if there are no more than MOST of them (and their type is one of whole numbers or strings)."""

    def __init__(self, rows: DataFrame, column: str) -> None:
        self.kind = rows.schema[column].dataType
        self.values: list | None = None
        if isinstance(self.kind, (T.IntegralType, T.StringType)):
            found = [r[0] for r in rows.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST + 1).collect()]  # MOST + 1 at most
            self.values = sorted(found) if len(found) <= MOST else None
        self.names = [f"__{column}{n}" for n in range(max(1, -(-len(self.values) // 64)))] if self.values is not None else [f"__{column}"]

    def marks(self, value: Column) -> list[Column]:
        """What stands for a value until it is put together: its bit, or itself."""
        if self.values is None:
            return [value.alias(self.names[0])]
        at = F.array_position(F.array(*map(F.lit, self.values)).cast(T.ArrayType(self.kind)), value).cast("int") - 1
        return [F.when((at >= 64 * n) & (at < 64 * n + 64), F.call_function("shiftleft", F.lit(1).cast("long"), at - 64 * n)).alias(name) for n, name in enumerate(self.names)]

    def together(self, when: Callable[[Column], Column] = lambda mark: mark) -> list[Column]:
        """Aggregations of marks, some of which may be made null."""
        return [(F.collect_set if self.values is None else F.bit_or)(when(F.col(name))).alias(name) for name in self.names]

    def members(self) -> Column:
        """The set, from the columns that together() names; empty for none."""
        kind = T.ArrayType(self.kind)
        none = F.array().cast(kind)
        if self.values is None:
            return F.coalesce(F.col(self.names[0]), none)
        pieces = []
        for at in range(0, len(self.values), 4):  # four bits by a table of the sets that they may stand for
            four = [F.lit(v) for v in self.values[at : at + 4]]
            table = F.array(*(F.array(*(v for n, v in enumerate(four) if bits >> n & 1)).cast(kind) for bits in range(1 << len(four))))
            bits = F.shiftrightunsigned(F.coalesce(F.col(self.names[at // 64]), F.lit(0).cast("long")), at % 64).bitwiseAND(F.lit((1 << len(four)) - 1).cast("long"))
            pieces.append(F.get(table, bits.cast("int")))
        return F.concat(*pieces) if pieces else none
