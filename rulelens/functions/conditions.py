"""The predicate algebra: immutable conditions that compile to Spark columns.

Null rules: `= v` is false on null, `!= v` and NOT IN are true on null, comparisons are false on
null and NaN, `= None` is IS NULL, and a pairwise condition is false if either side is null.
Literals are typed: a text never equals a number, so such conditions compile to constants.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_WORDS = ("none", "null", "nan", "na", "<na>")


def normalized(value: Any) -> Any:
    """None for null words and NaN; whole floats as integers, so equal numbers are one value."""
    if value is None or isinstance(value, float) and value != value:
        return None
    if isinstance(value, str):
        return None if value.strip().lower() in NULL_WORDS else value
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def _fits(kind: T.DataType, value: Any) -> bool:
    """Whether a column of this type can equal the literal at all."""
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return isinstance(value, (bool, int, float))
    return True


def _same(column: Column, kind: T.DataType, value: Any) -> Column:
    """column = value, never null."""
    if value is None:
        return column.isNull()
    if not _fits(kind, value):
        return F.lit(False)
    if isinstance(kind, T.BooleanType):
        column = column.cast("int")
    return F.coalesce(column == F.lit(int(value) if isinstance(value, bool) else value), F.lit(False))


class Condition:
    """Base: `columns`, `to_column(schema, alias)`, `to_dict`, and a sentence as `str`."""

    def columns(self) -> frozenset[str]:
        return frozenset([self.column])

    def to_column(self, schema: T.StructType, alias: str | None = None) -> Column:
        raise NotImplementedError

    def to_dict(self) -> dict:
        raise NotImplementedError

    @staticmethod
    def _pick(schema: T.StructType, name: str, alias: str | None) -> tuple[Column, T.DataType] | None:
        if name not in schema.names:
            return None
        return F.col(f"{alias}.`{name}`" if alias else f"`{name}`"), schema[name].dataType


def _checked(op: str, allowed: tuple[str, ...]) -> None:
    if op not in allowed:
        raise ValueError(f"operator {op!r}: one of {', '.join(allowed)} is needed")


@dataclass(frozen=True)
class PairWise(Condition):
    """Two rows agree (=) or differ (!=) on a column."""

    column: str
    op: str

    def __post_init__(self):
        _checked(self.op, ("=", "!="))

    def __str__(self) -> str:
        return f'two rows have {"the same value" if self.op == "=" else "different values"} in the "{self.column}" column'

    def to_column(self, schema: T.StructType, alias: str | None = None) -> Column:
        raise ValueError("a pairwise condition needs two rows: use pair_column")

    def pair_column(self, left: str = "a", right: str = "b") -> Column:
        a, b = F.col(f"{left}.`{self.column}`"), F.col(f"{right}.`{self.column}`")
        return F.coalesce(a == b if self.op == "=" else a != b, F.lit(False))

    def to_dict(self) -> dict:
        return {"type": "PairWiseCondition", "kwargs": {"column_name": self.column, "operator": self.op}}


@dataclass(frozen=True)
class ColumnValue(Condition):
    """column = value or column != value."""

    column: str
    op: str
    value: Any

    def __post_init__(self):
        _checked(self.op, ("=", "!="))

    def __str__(self) -> str:
        return f'the "{self.column}" column {"has" if self.op == "=" else "does not have"} the value of: {self.value}'

    def to_column(self, schema: T.StructType, alias: str | None = None) -> Column:
        found = self._pick(schema, self.column, alias)
        if found is None:
            return F.lit(False)
        same = _same(*found, self.value)
        return same if self.op == "=" else ~same

    def to_dict(self) -> dict:
        return {"type": "ColumnValueCondition", "kwargs": {"column_name": self.column, "operator": self.op, "value": self.value}}


@dataclass(frozen=True)
class Numerical(Condition):
    """column < threshold or column >= threshold."""

    column: str
    op: str
    value: float

    def __post_init__(self):
        _checked(self.op, ("<", ">="))

    def __str__(self) -> str:
        return f'the "{self.column}" column is {"less than" if self.op == "<" else "greater than or equal to"}: {self.value}'

    def to_column(self, schema: T.StructType, alias: str | None = None) -> Column:
        found = self._pick(schema, self.column, alias)
        if found is None or not isinstance(found[1], T.NumericType):
            return F.lit(False)
        number = F.nanvl(found[0].cast("double"), F.lit(None).cast("double"))
        return F.coalesce(number < F.lit(self.value) if self.op == "<" else number >= F.lit(self.value), F.lit(False))

    def to_dict(self) -> dict:
        return {"type": "NumericalCondition", "kwargs": {"column_name": self.column, "operator": self.op, "value": self.value}}


@dataclass(frozen=True)
class MergedValues(Condition):
    """column IN values or column NOT IN values; None among them means null."""

    column: str
    values: frozenset
    op: str

    def __post_init__(self):
        _checked(self.op, ("=", "!="))
        object.__setattr__(self, "values", frozenset(self.values))

    def __str__(self) -> str:
        shown = sorted(self.values, key=lambda v: (v is None, isinstance(v, str), v if not isinstance(v, str) and v is not None else 0, str(v)))
        return f'the "{self.column}" column value {"is in" if self.op == "=" else "is not in"} the set: {shown}'

    def to_column(self, schema: T.StructType, alias: str | None = None) -> Column:
        found = self._pick(schema, self.column, alias)
        if found is None:
            return F.lit(False)
        column, kind = found
        some = [v for v in self.values if v is not None and _fits(kind, v)]
        inside = F.coalesce(column.isin(some), F.lit(False)) if some else F.lit(False)
        if None in self.values:
            inside = inside | column.isNull()
        return inside if self.op == "=" else ~inside

    def to_dict(self) -> dict:
        return {"type": "MergedColumnValueCondition", "kwargs": {"column_name": self.column, "value_set": sorted(self.values, key=str), "operator": self.op}}


@dataclass(frozen=True)
class Conjunction(Condition):
    """All of several row-level conditions."""

    conditions: frozenset

    def __post_init__(self):
        object.__setattr__(self, "conditions", frozenset(self.conditions))
        if any(isinstance(c, PairWise) for c in self.conditions):
            raise ValueError("pairwise conditions can't be conjoined with conditions on rows")

    def __str__(self) -> str:
        return " AND ".join(sorted(str(c) for c in self.conditions))

    def columns(self) -> frozenset[str]:
        return frozenset().union(*(c.columns() for c in self.conditions)) if self.conditions else frozenset()

    def to_column(self, schema: T.StructType, alias: str | None = None) -> Column:
        out = F.lit(True)
        for c in sorted(self.conditions, key=str):
            out = out & c.to_column(schema, alias)
        return out

    def to_dict(self) -> dict:
        return {"type": "ConjunctiveCondition", "kwargs": {"conditions": [c.to_dict() for c in sorted(self.conditions, key=str)]}}


def from_dict(data: dict | None) -> Condition | None:
    """A condition of its stored form; None if that is empty or unknown."""
    if not isinstance(data, dict) or not data.get("type"):
        return None
    kind, args = data["type"], data.get("kwargs") or {}
    try:
        if kind == "ConjunctiveCondition":
            return Conjunction(frozenset(filter(None, map(from_dict, args.get("conditions", [])))))
        if kind == "MergedColumnValueCondition":
            return MergedValues(args["column_name"], frozenset(args.get("value_set", [])), args["operator"])
        if kind == "PairWiseCondition":
            return PairWise(args["column_name"], args["operator"])
        if kind == "ColumnValueCondition":
            return ColumnValue(args["column_name"], args["operator"], args["value"])
        if kind == "NumericalCondition":
            return Numerical(args["column_name"], args["operator"], args["value"])
    except (KeyError, TypeError, ValueError):
        return None
    return None


def pair_column(condition: Condition, schema: T.StructType, left: str = "a", right: str = "b") -> Column:
    """A condition over two rows: a row-level one must hold on both."""
    if isinstance(condition, PairWise):
        return condition.pair_column(left, right)
    return condition.to_column(schema, left) & condition.to_column(schema, right)


def columns_of(conditions: Iterable[Condition]) -> frozenset[str]:
    """All columns that the conditions mention."""
    return frozenset().union(*(c.columns() for c in conditions)) if conditions else frozenset()
