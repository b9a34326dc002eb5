"""Conditions over stored rows, bound to Spark columns.

Types are static: columns have one, literals carry their own, and values of different types
(or NULL) compare to unknown. Errors in a condition are lazy: they belong to rows. A bound
condition therefore has a boolean Column and a list of (error, when) in the order
in which one row would meet them.

Physical columns are named by place: c0, c1, ... and s0, s1, ... for the scales of decimals.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..functions.errors import DbError
from ..functions.values import DIGITS, DataType, Number, kind
from . import syntax as S

_MIRROR = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_APPLY = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}

#: Terms of a condition that are combined one by one.
LONG_CHAIN = 64


@dataclass
class Column:
    name: str
    type: DataType
    not_null: bool


@dataclass
class Table:
    id: int
    name: str
    columns: list[Column]
    key: int
    segments: list = field(default_factory=list)

    def index(self, name: str) -> int | None:
        return next((i for i, c in enumerate(self.columns) if c.name == name), None)

    def place(self, name: str) -> int:
        at = self.index(name)
        if at is None:
            raise unknown_column(name)
        return at

    @property
    def key_column(self) -> Column:
        return self.columns[self.key]


def unknown_column(name: str) -> DbError:
    return DbError("UNKNOWN_COLUMN", f"there is no column {name}")


def mismatch(message: str) -> DbError:
    return DbError("TYPE_MISMATCH", message)


def unknown() -> SparkColumn:
    return F.lit(None).cast("boolean")


def known(value: bool | None) -> SparkColumn:
    return unknown() if value is None else F.lit(value)


@dataclass
class Value:
    """An operand: its type's name, its column, its literal (if it is one) and its type (if it is a stored column)."""

    kind: str
    column: SparkColumn | None
    literal: Any = None
    is_literal: bool = False
    type: DataType | None = None


@dataclass
class Condition:
    column: SparkColumn
    errors: list[tuple[DbError, SparkColumn]]


def compare_values(op: str, a: Any, b: Any) -> bool | None:
    """A comparison of two plain values; None is unknown."""
    if a is None or b is None or kind(a) != kind(b):
        return None
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    return _APPLY[op](a, b)


def _unless_null(column: SparkColumn, value: bool) -> SparkColumn:
    return F.when(column.isNotNull(), F.lit(value))


def _decimal_literal(op: str, column: SparkColumn, t: DataType, value: Number) -> SparkColumn:
    """column op value, decided on whole units of the column's scale, so no common type is needed."""
    if value.scale <= t.scale:
        low, exact = value.at(t.scale), True
    else:
        step = 10 ** (value.scale - t.scale)
        low, exact = value.units // step, value.units % step == 0
    most = 10**t.precision - 1
    if not exact:
        # Between low and low + 1 units.
        if op in ("=", "!="):
            return _unless_null(column, op == "!=")
        op = "<=" if op in ("<", "<=") else ">"
    if abs(low) > most:
        above = low > most
        return _unless_null(column, {"=": False, "!=": True, "<": above, "<=": above, ">": not above, ">=": not above}[op])
    return _APPLY[op](column, F.lit(Number(low, t.scale).python()).cast(t.spark()))


def _order_key(column: SparkColumn) -> SparkColumn:
    """A text that orders as the decimal does: sign, then padded digits (their complement below zero)."""
    text = column.cast("string")
    digits = F.concat(F.lpad(F.regexp_extract(text, r"^-?(\d*)", 1), DIGITS, "0"), F.rpad(F.regexp_extract(text, r"\.(\d*)$", 1), DIGITS, "0"))
    return F.when(column < 0, F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("1"), digits))


def compare(op: str, a: Value, b: Value) -> SparkColumn:
    if a.kind != b.kind or a.kind == "NULL":
        return unknown()
    if a.is_literal and b.is_literal:
        return known(compare_values(op, a.literal, b.literal))
    if a.is_literal:
        return compare(_MIRROR[op], b, a)
    if a.kind == "DECIMAL":
        if b.is_literal:
            return _decimal_literal(op, a.column, a.type, b.literal)
        whole = max(a.type.precision - a.type.scale, b.type.precision - b.type.scale)
        if whole + max(a.type.scale, b.type.scale) > DIGITS:
            return F.when(a.column.isNotNull() & b.column.isNotNull(), _APPLY[op](_order_key(a.column), _order_key(b.column)))
    right = F.lit(b.literal) if b.is_literal else b.column
    return _APPLY[op](a.column, right)


class Binder:
    def __init__(self, table: Table):
        self.table = table
        self.errors: list[tuple[DbError, SparkColumn]] = []

    def value(self, e: Any) -> Value:
        if isinstance(e, S.Literal):
            name = kind(e.value)
            column = None
            if name != "NULL":
                column = F.lit(e.value.python()) if name == "DECIMAL" else F.lit(e.value)
            return Value(name, column, e.value, True)
        if isinstance(e, S.Column):
            at = self.table.index(e.name)
            if at is None:
                self.errors.append((unknown_column(e.name), F.lit(True)))
                return Value("NULL", None)
            t = self.table.columns[at].type
            return Value(t.name, F.col(f"c{at}"), type=t)
        return Value("BOOLEAN", self.truth(e))

    def chain(self, e: Any) -> SparkColumn:
        """Terms joined by one operator, bound left to right. Many of them become an array, since Spark walks long chains recursively."""
        op, terms = e.op, []
        while isinstance(e, S.Logic) and e.op == op:
            terms.append(e.right)
            e = e.left
        columns = [self.truth(t) for t in [e, *reversed(terms)]]
        if len(columns) > LONG_CHAIN:
            return (F.forall if op == "AND" else F.exists)(F.array(*columns), lambda x: x)
        out = columns[0]
        for c in columns[1:]:
            out = out & c if op == "AND" else out | c
        return out

    def truth(self, e: Any) -> SparkColumn:
        if isinstance(e, S.Compare):
            left = self.value(e.left)
            return compare(e.op, left, self.value(e.right))
        if isinstance(e, S.Logic):
            return self.chain(e)
        if isinstance(e, S.Not):
            return ~self.truth(e.inner)
        if isinstance(e, S.IsNull):
            inner = self.value(e.inner)
            null = F.lit(True) if inner.column is None else inner.column.isNull()
            return ~null if e.negated else null
        v = self.value(e)
        if v.kind == "BOOLEAN":
            return v.column
        if v.column is not None:
            self.errors.append((mismatch("a condition must be a BOOLEAN"), v.column.isNotNull()))
        return unknown()


def bind(where: Any, table: Table) -> Condition:
    if where is None:
        return Condition(F.lit(True), [])
    binder = Binder(table)
    column = binder.truth(where)
    return Condition(column, binder.errors)


@dataclass
class KeyBounds:
    """The last bound on each side that the top-level AND terms set on the key: (operator, literal)."""

    low: tuple[str, Any] | None = None
    high: tuple[str, Any] | None = None


def key_bounds(where: Any, table: Table) -> KeyBounds:
    out = KeyBounds()

    # Left to right without recursion: a long chain of terms is deep on its left side.
    held = [where]
    while held:
        e = held.pop()
        if isinstance(e, S.Logic) and e.op == "AND":
            held += [e.right, e.left]
        elif isinstance(e, S.Compare) and e.op != "!=":
            for op, a, b in ((e.op, e.left, e.right), (_MIRROR[e.op], e.right, e.left)):
                if isinstance(a, S.Column) and isinstance(b, S.Literal) and a.name == table.key_column.name:
                    if op in ("=", ">", ">="):
                        out.low = (">=" if op == "=" else op, b.value)
                    if op in ("=", "<", "<="):
                        out.high = ("<=" if op == "=" else op, b.value)
                    break
    return out


def bound_column(bound: tuple[str, Any], table: Table) -> SparkColumn:
    key = table.key_column
    return compare(bound[0], Value(key.type.name, F.col(f"c{table.key}"), type=key.type), Value(kind(bound[1]), None, bound[1], True))
