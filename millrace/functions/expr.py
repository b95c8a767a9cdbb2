"""Typed expressions: a value column, its logical type, the row errors that it may raise, and whether it is sensitive.

Types must fit exactly; nothing is cast implicitly. An operation that fails on a row gives null and a row error, so that
one bad row never ends a job. An error column holds the number of the first error (null without one), which only error routes
expand to its code and operation: generated code stays small. All of it is plain columns, so that Catalyst sees through it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import types as T

ERROR = "array<struct<code:string,operation:string>>"
#: Code and operation of every row error that an expression may raise -> its number, from 1 on.
NUMBERS: dict[tuple[str, str], int] = {}


class SchemaError(TypeError):
    """An expression or route that doesn't fit its schemas."""


@dataclass(frozen=True)
class Expr:
    value: Column
    type: str
    error: Column | None = None
    sensitive: bool = False
    volatile: bool = False
    #: The value itself if it is a literal.
    constant: object = None
    #: Tables that must be joined before the value is there: functions from a table to one with more columns, by name.
    lookups: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = ()

    # comparisons and logic follow SQL's three values
    def compare(self, other: Expr, how: Callable[[Column, Column], Column], ordered: bool) -> Expr:
        if self.type != other.type:
            raise SchemaError(f"can't compare {self.type} with {other.type}")
        if ordered and self.type not in (*T.NUMBERS, "STRING", "DATETIME"):
            raise SchemaError(f"{self.type} has no order")
        return join("BOOL", how(self.value, other.value), self, other)

    def eq(self, other: Expr) -> Expr:
        return self.compare(other, Column.__eq__, False)

    def ne(self, other: Expr) -> Expr:
        return self.compare(other, Column.__ne__, False)

    def __lt__(self, other: Expr) -> Expr:
        return self.compare(other, Column.__lt__, True)

    def __le__(self, other: Expr) -> Expr:
        return self.compare(other, Column.__le__, True)

    def __gt__(self, other: Expr) -> Expr:
        return self.compare(other, Column.__gt__, True)

    def __ge__(self, other: Expr) -> Expr:
        return self.compare(other, Column.__ge__, True)

    def logic(self, other: Expr, how: Callable[[Column, Column], Column]) -> Expr:
        if {self.type, other.type} != {"BOOL"}:
            raise SchemaError("AND and OR take BOOL")
        return join("BOOL", how(self.value, other.value), self, other)

    def __and__(self, other: Expr) -> Expr:
        return self.logic(other, Column.__and__)

    def __or__(self, other: Expr) -> Expr:
        return self.logic(other, Column.__or__)

    def __invert__(self) -> Expr:
        if self.type != "BOOL":
            raise SchemaError("NOT takes BOOL")
        return join("BOOL", ~self.value, self)

    def __add__(self, other: Expr) -> Expr:
        return arithmetic("+", self, other)

    def __sub__(self, other: Expr) -> Expr:
        return arithmetic("-", self, other)

    def __mul__(self, other: Expr) -> Expr:
        return arithmetic("*", self, other)

    def __truediv__(self, other: Expr) -> Expr:
        return arithmetic("/", self, other)

    def __mod__(self, other: Expr) -> Expr:
        return arithmetic("%", self, other)

    def __neg__(self) -> Expr:
        if self.type not in T.NUMBERS:
            raise SchemaError("- takes a number")
        return arithmetic("-", replace(self, value=F.lit(0).cast(T.spark(self.type)), error=None, constant=None), self)

    def leak(self) -> Expr:
        """The same value, no longer sensitive."""
        return replace(self, sensitive=False)

    def errors(self) -> Column:
        """The row error as an array, empty without one."""
        none = F.array().cast(ERROR)
        return none if self.error is None else F.when(self.error.isNull(), none).otherwise(F.array(expanded(self.error)))


def join(kind: str, value: Column, *parts: Expr, failed: Column | None = None, code: str = "", operation: str = "") -> Expr:
    """An expression made of parts: their errors together, and one of its own where failed holds."""
    errors = [p.error for p in parts if p.error is not None]
    if failed is not None:
        errors.append(F.when(failed, F.lit(NUMBERS.setdefault((code, operation), len(NUMBERS) + 1))))
    lookups = tuple(dict(x for p in parts for x in p.lookups).items())
    return Expr(value, kind, first_error(errors), any(p.sensitive for p in parts), any(p.volatile for p in parts), lookups=lookups)


def first_error(errors: Sequence[Column]) -> Column | None:
    return None if not errors else errors[0] if len(errors) == 1 else F.coalesce(*errors)


def expanded(number: Column) -> Column:
    """Code and operation of an error's number."""
    entries = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(o).alias("operation")) for c, o in NUMBERS])
    return F.get(entries, number - 1)


def given(*parts: Expr) -> Column:
    """All parts are there."""
    out = F.lit(True)
    for p in parts:
        out = out & p.value.isNotNull()
    return out


def finite(value: Column) -> Column:
    """The value as a double, or null if it isn't finite. The operand is written once, so that nested arithmetic doesn't double in size by level."""
    return F.nanvl(value % F.lit(float("inf")), F.lit(None).cast("double"))  # the rest by infinity is the value itself, or nan


def within(value: Column, kind: str) -> Column:
    """The value in the type of kind, or null if that type doesn't hold it."""
    low, high = T.limits(kind)
    wide = value.cast("decimal(38,0)")
    return F.when(wide.between(F.lit(Decimal(low)).cast("decimal(38,0)"), F.lit(Decimal(high)).cast("decimal(38,0)")), value).try_cast(T.spark(kind))


def arithmetic(sign: str, a: Expr, b: Expr) -> Expr:
    """+ - * / % of two numbers of one type. Integers divide towards zero and never wrap; floats stay finite."""
    if a.type != b.type or a.type not in T.NUMBERS:
        raise SchemaError(f"{sign} takes two numbers of one type, not {a.type} and {b.type}")
    x, y, there = a.value, b.value, given(a, b)
    if a.type in T.FLOATS:
        raw = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.try_mod(x, y)}[sign]
        value = finite(raw).cast(T.spark(a.type))
        return join(a.type, value, a, b, failed=there & value.isNull(), code="invalid_argument", operation=sign)
    if sign in "/%":
        zero = there & (y == 0)
        # U64 is a decimal, whose division would round: what divides without a rest doesn't
        whole = F.try_divide(x - F.try_mod(x, y), y) if a.type == "U64" else F.call_function("div", x, y)
        raw = F.when(y != 0, whole if sign == "/" else F.try_mod(x, y))
        low = T.limits(a.type)[0]
        over = there & (x == F.lit(low).cast(T.spark(a.type))) & (y == -1) if a.type[0] == "I" else F.lit(False)
        value = F.when(~over, raw).cast(T.spark(a.type)) if sign == "/" else F.when(over, F.lit(0)).otherwise(raw).cast(T.spark(a.type))
        first = join(a.type, value, a, b, failed=zero, code="division_by_zero", operation=sign)
        return join(a.type, value, first, failed=over, code="overflow", operation=sign) if sign == "/" and a.type[0] == "I" else first
    raw = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[sign](x, y)
    value = within(raw, a.type) if a.type[0] == "U" else raw.cast(T.spark(a.type))
    return join(a.type, value, a, b, failed=there & value.isNull(), code="overflow", operation=sign)


def field(name: str, kind: str, sensitive: bool = False) -> Expr:
    """A column of the input."""
    return Expr(F.col(name), kind, sensitive=sensitive)


def lit(value: int | float | bool | str, kind: str | None = None) -> Expr:
    """A literal: whole numbers are I64, others F64, unless kind says otherwise."""
    own = "BOOL" if isinstance(value, bool) else "I64" if isinstance(value, int) else "F64" if isinstance(value, float) else "STRING"
    large = isinstance(value, int) and not -(2**63) <= value < 2**63
    return Expr(F.lit(Decimal(value) if large else value).cast(T.spark(kind or own)), kind or own, constant=value)


def null(kind: str) -> Expr:
    return Expr(F.lit(None).cast(T.spark(kind)), kind)


def of_table(df: DataFrame, sensitive: set[str] | frozenset[str] = frozenset()) -> dict[str, Expr]:
    """Expressions for all columns of a table that have a logical type."""
    out = {}
    for name, kind in df.dtypes:
        try:
            out[name] = field(name, T.logical(kind), name in sensitive)
        except TypeError:
            continue
    return out
