"""Four types, exact decimals that keep their digits, and their Spark forms.

A decimal is an integer of units and a scale; ``12.20`` and ``12.2`` compare equal and print
as written. In storage the value is a Spark decimal of the column's type and the scale
stands beside it in a hidden byte column.
"""

from __future__ import annotations

import decimal
import re
from dataclasses import dataclass
from functools import total_ordering
from typing import Any

from pyspark.sql import types as T

DIGITS = 38
_WIDE = decimal.Context(prec=2 * DIGITS + 4)
_NUMBER = re.compile(r"([+-]?)([0-9]*)(?:\.([0-9]+))?")


@total_ordering
@dataclass(frozen=True, eq=False)
class Number:
    units: int
    scale: int

    @staticmethod
    def parse(text: str) -> Number:
        m = _NUMBER.fullmatch(text)
        if not m or not (m[2] or m[3]):
            raise ValueError(f"{text} is not a decimal")
        whole, part = m[2], m[3] or ""
        units = int(whole + part)
        if len(str(units)) > DIGITS or len(part) > DIGITS:
            raise ValueError(f"{text} has more than {DIGITS} digits")
        return Number(-units if m[1] == "-" else units, len(part))

    def at(self, scale: int) -> int:
        """Units at a larger scale."""
        return self.units * 10 ** (scale - self.scale)

    def __eq__(self, other) -> bool:
        scale = max(self.scale, other.scale)
        return self.at(scale) == other.at(scale)

    def __lt__(self, other) -> bool:
        scale = max(self.scale, other.scale)
        return self.at(scale) < other.at(scale)

    def __hash__(self) -> int:
        return hash(self.reduced())

    def reduced(self, least: int = 0) -> tuple[int, int]:
        """Units and scale without trailing zeros, as far as the scale stays at least that."""
        units, scale = self.units, self.scale
        while scale > least and units % 10 == 0:
            units, scale = units // 10, scale - 1
        return units, scale

    def fits(self, precision: int, scale: int) -> bool:
        units, own = self.reduced(scale)
        return own <= scale and len(str(abs(units))) + (scale - own) <= precision

    def python(self) -> decimal.Decimal:
        return decimal.Decimal(self.units).scaleb(-self.scale, _WIDE)

    def __str__(self) -> str:
        digits = str(abs(self.units)).rjust(self.scale + 1, "0")
        whole, part = digits[: len(digits) - self.scale], digits[len(digits) - self.scale :]
        return ("-" if self.units < 0 else "") + whole + ("." + part if part else "")


@dataclass(frozen=True)
class DataType:
    name: str
    precision: int = 0
    scale: int = 0

    @staticmethod
    def parse(text: str) -> DataType:
        plain = text.strip().upper()
        if plain in ("INTEGER", "TEXT", "BOOLEAN"):
            return DataType(plain)
        m = re.fullmatch(r"DECIMAL\(\s*(\S+?)\s*,\s*(\S+?)\s*\)", plain)
        if not m:
            raise ValueError(f"{text} is not a type")
        if not (m[1].isascii() and m[1].isdigit() and m[2].isascii() and m[2].isdigit() and 1 <= int(m[1]) <= DIGITS and int(m[2]) <= int(m[1])):
            raise ValueError(f"{text} is not a precision from 1 to {DIGITS} and a scale up to it")
        return DataType("DECIMAL", int(m[1]), int(m[2]))

    def __str__(self) -> str:
        return f"DECIMAL({self.precision},{self.scale})" if self.name == "DECIMAL" else self.name

    def spark(self) -> T.DataType:
        if self.name == "DECIMAL":
            return T.DecimalType(self.precision, self.scale)
        return {"INTEGER": T.LongType(), "TEXT": T.StringType(), "BOOLEAN": T.BooleanType()}[self.name]

    def admits(self, value: Any) -> bool:
        """Whether a non-null value can stand in a column of this type."""
        return kind(value) == self.name and (self.name != "DECIMAL" or value.fits(self.precision, self.scale))

    def stored(self, value: Any) -> Any:
        return value.python() if isinstance(value, Number) else value


def kind(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "BOOLEAN"
    return {int: "INTEGER", str: "TEXT", Number: "DECIMAL"}[type(value)]


def from_stored(value: Any, scale: int | None) -> Any:
    """A Python value of a result row; a decimal takes the digits it was written with."""
    if isinstance(value, decimal.Decimal):
        return Number(int(value.scaleb(scale, _WIDE)), scale)
    return value


def shown(value: Any) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else str(value)


def to_wire(value: Any) -> Any:
    if value is None:
        return "Null"
    name = kind(value)
    return {name.capitalize(): str(value) if name == "DECIMAL" else value}


def from_wire(value: Any) -> Any:
    if value == "Null":
        return None
    if not isinstance(value, dict) or len(value) != 1:
        raise ValueError("a value is Null or an object with one member")
    (name, inner), want = next(iter(value.items())), {"Integer": int, "Text": str, "Boolean": bool, "Decimal": str}
    if type(inner) is not want.get(name):
        raise ValueError(f"{name} does not hold {inner!r}")
    return Number.parse(inner) if name == "Decimal" else inner
