"""A typed expression builder: admits what the engine can compute with the right meaning, refuses the rest.

Plain Spark coerces silently.  Here every operand has a resolved type, comparisons run under an explicit common
type, and combinations whose result would depend on rounding or on the order of rows raise ``Refused``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions import semantics

MAX_DIGITS = 38
#: Decimals up to this many digits convert to a double by one rounding.
DOUBLE_DIGITS = 15


class Refused(TypeError):
    """An expression that is not computed here."""


@dataclass(frozen=True)
class Typed:
    """A column with its resolved type: kind is int, decimal, double, date, datetime, string or bool."""

    column: Column
    kind: str
    digits: int = 0
    scale: int = 0
    derived: bool = False  # an average or a quotient, whose scale is metadata

    # -- comparison

    def _as(self, kind: str, digits: int = 0, scale: int = 0) -> Column:
        if kind == "decimal":
            return self.column.cast(f"decimal({digits},{scale})")
        if kind == "double":
            if self.kind == "decimal" and self.digits > DOUBLE_DIGITS:
                return self.column.cast("string").cast("double")  # rounds once
            return self.column.cast("double")
        return semantics.moment(self.column) if kind == "datetime" else self.column

    def compare(self, op: str, *others: "Typed") -> "Typed":
        """op is one of = <> < <= > >= between in; all operands meet under one type."""
        every = (self, *others)
        kind, digits, scale = common(every)
        a, *rest = (x._as(kind, digits, scale) for x in every)
        if op == "between":
            return Typed((a >= rest[0]) & (a <= rest[1]), "bool")
        if op == "in":
            return Typed(a.isin(*rest), "bool")
        found = {"=": a == rest[0], "<>": a != rest[0], "<": a < rest[0], "<=": a <= rest[0], ">": a > rest[0], ">=": a >= rest[0]}
        if op not in found:
            raise Refused(f"comparison {op}")
        return Typed(found[op], "bool")

    # -- arithmetic

    def _numbers(self, other: "Typed") -> None:
        if not {self.kind, other.kind} <= {"int", "decimal", "double"}:
            raise Refused(f"arithmetic over {self.kind} and {other.kind}")

    def _sum(self, other: "Typed", f) -> "Typed":
        self._numbers(other)
        if "double" in (self.kind, other.kind):
            return _double(f(self._double(other), other._double(self)))
        if self.kind == other.kind == "int":
            return Typed(f(self.column, other.column), "int")
        scale = max(self.scale, other.scale)
        whole = max(self.whole, other.whole)
        return _decimal(f(self.column, other.column), whole + 1 + scale, scale)

    def __add__(self, other: "Typed") -> "Typed":
        return self._sum(other, lambda a, b: a + b)

    def __sub__(self, other: "Typed") -> "Typed":
        return self._sum(other, lambda a, b: a - b)

    def __mul__(self, other: "Typed") -> "Typed":
        self._numbers(other)
        if "double" in (self.kind, other.kind):
            return _double(self._double(other) * other._double(self))
        if self.kind == other.kind == "int":
            return Typed(self.column * other.column, "int")
        return _decimal(self.column * other.column, self.whole + other.whole + self.scale + other.scale, self.scale + other.scale)

    def __truediv__(self, other: "Typed") -> "Typed":
        self._numbers(other)
        if "double" in (self.kind, other.kind):
            return _double(F.try_divide(self._double(other), other._double(self)))
        if self.scale + 4 > 30:
            raise Refused("quotient of too large a scale")
        return Typed(semantics.divide(self.column, other.column.cast("decimal(25,%d)" % min(other.scale, 25)), self.scale), "decimal", MAX_DIGITS, self.scale + 4, True)

    def __mod__(self, other: "Typed") -> "Typed":
        self._numbers(other)
        if "double" in (self.kind, other.kind):
            raise Refused("remainder of doubles")
        return Typed(semantics.remainder(self.column, other.column), self.kind if self.kind == other.kind else "decimal", max(self.digits, other.digits), max(self.scale, other.scale))

    @property
    def whole(self) -> int:
        return 19 if self.kind == "int" else self.digits - self.scale

    def _double(self, other: "Typed") -> Column:
        if self.kind == "decimal" and self.derived:
            raise Refused("an average or a quotient next to a double")
        return self._as("double")

    # -- aggregates

    def sum(self) -> "Typed":
        if self.kind not in ("int", "decimal"):
            raise Refused(f"SUM over {self.kind}: it would depend on the order of rows")
        digits = MAX_DIGITS if self.kind == "decimal" else 38
        return Typed(F.sum(self.column.cast(f"decimal({min(digits, 38)},{self.scale})")), "decimal", digits, self.scale)

    def avg(self) -> "Typed":
        if self.kind not in ("int", "decimal"):
            raise Refused(f"AVG over {self.kind}: it would depend on the order of rows")
        return Typed(semantics.average(F.sum(self.column.cast(f"decimal(25,{self.scale})")), F.count(self.column), self.scale), "decimal", MAX_DIGITS, self.scale + 4, True)


def _double(c: Column) -> Typed:
    return Typed(semantics.finite(c), "double")


def _decimal(c: Column, digits: int, scale: int) -> Typed:
    if scale > 30:
        raise Refused("a decimal of more than 30 digits after the point")
    digits = min(digits, MAX_DIGITS)
    return Typed(c.cast(f"decimal({digits},{scale})"), "decimal", digits, scale)


def common(operands: tuple[Typed, ...]) -> tuple[str, int, int]:
    """The type under which operands are compared."""
    kinds = {x.kind for x in operands}
    if kinds <= {"int"} or kinds in ({"bool"}, {"string"}, {"date"}):
        return operands[0].kind, 0, 0
    if kinds <= {"int", "decimal"}:
        scale = max(x.scale for x in operands)
        digits = max(x.whole for x in operands) + scale
        if digits > MAX_DIGITS:
            digits = MAX_DIGITS
        return "decimal", digits, scale
    if kinds <= {"int", "decimal", "double"}:
        for x in operands:
            if x.derived:
                raise Refused("an average or a quotient next to a double")
            if x.kind == "int" or x.digits > DOUBLE_DIGITS:
                # an integer or wide decimal loses digits as a double, unless it is a constant
                raise Refused(f"{x.kind} of more than {DOUBLE_DIGITS} digits next to a double")
        return "double", 0, 0
    if kinds <= {"date", "datetime", "string"} and kinds & {"date", "datetime"}:
        return "datetime", 0, 0
    raise Refused("comparison of " + ", ".join(sorted(kinds)))


def field(df: DataFrame, name: str) -> Typed:
    """A column of a DataFrame with its resolved type."""
    kind = df.schema[name].dataType
    c = df[name]
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Typed(c.cast("long"), "int")
    if isinstance(kind, T.DecimalType):
        return Typed(c, "decimal", kind.precision, kind.scale)
    for cls, name_ in ((T.DoubleType, "double"), (T.DateType, "date"), (T.TimestampNTZType, "datetime"), (T.StringType, "string"), (T.BooleanType, "bool")):
        if isinstance(kind, cls):
            return Typed(c, name_)
    raise Refused(f"columns of {kind.simpleString()}")


def constant(value) -> Typed:
    """A literal; decimals from text, so that no float touches them."""
    from datetime import date, datetime
    from decimal import Decimal

    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long"), "int")
    if isinstance(value, Decimal):
        _, digits, exponent = value.as_tuple()
        scale = max(0, -exponent)
        size = max(len(digits) + max(0, exponent), scale)
        return Typed(F.lit(str(value)).cast(f"decimal({size},{scale})"), "decimal", size, scale)
    if isinstance(value, float):
        return Typed(F.lit(value), "double")
    if isinstance(value, datetime):
        return Typed(F.lit(value.isoformat(" ")).cast("timestamp_ntz"), "datetime")
    if isinstance(value, date):
        return Typed(F.lit(value), "date")
    if isinstance(value, str):
        return Typed(F.lit(value), "string")
    raise Refused(f"constants of {type(value).__name__}")
