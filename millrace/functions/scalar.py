"""The scalar functions, CASE, casts and user functions. Null in gives null out unless a function says otherwise."""

from __future__ import annotations

import dataclasses
import itertools
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import types as T
from millrace.functions.expr import Expr, SchemaError, finite, first_error, given, join, within

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"\p{IsWhite_Space}+"
FUNCTIONS: dict[str, Callable[..., Expr]] = {}


def function(*names: str) -> Callable[[Callable[..., Expr]], Callable[..., Expr]]:
    def keep(f: Callable[..., Expr]) -> Callable[..., Expr]:
        for name in names or (f.__name__.rstrip("_"),):
            FUNCTIONS[name] = f
        return f

    return keep


def call(name: str, *args: Expr) -> Expr:
    """A function by its name, in any case of letters."""
    if name.lower() not in FUNCTIONS:
        raise SchemaError(f"no function {name}")
    return FUNCTIONS[name.lower()](*args)


def expect(name: str, args: Sequence[Expr], *kinds: str | tuple[str, ...]) -> None:
    """Check the types of arguments."""
    if len(args) != len(kinds):
        raise SchemaError(f"{name} takes {len(kinds)} arguments")
    for a, k in zip(args, kinds, strict=True):
        if a.type != k and a.type not in k if isinstance(k, tuple) else a.type != k:
            raise SchemaError(f"{name} can't take {a.type}")


def simple(name: str, kinds: tuple[str, ...], result: str, make: Callable[..., Column]) -> None:
    """A function without errors."""

    def f(*args: Expr) -> Expr:
        expect(name, args, *kinds)
        return join(result, make(*[a.value for a in args]), *args)

    FUNCTIONS[name] = f


INT = T.INTEGERS
#: Longest text, in bytes, that repeat, lpad and rpad make; beyond it they give null and a row error.
LONGEST = 16 << 20
SERIAL = itertools.count()


def small(n: Expr) -> Column:
    """An integer argument as a 32-bit one; larger ones count as the largest, which no text or list reaches."""
    wide = n.value if n.type == "U64" else n.value.cast("bigint")
    kind = T.spark("U64") if n.type == "U64" else "bigint"
    return F.greatest(F.least(wide, F.lit(2**31 - 1).cast(kind)), F.lit(1 - 2**31).cast(kind)).cast("int")


#: Functions of fixed types: names, argument types, result type, column.
for _names, _kinds, _result, _make in (
    (("lower",), ("STRING",), "STRING", lambda x: F.translate(x, UPPER, LOWER)),
    (("upper",), ("STRING",), "STRING", lambda x: F.translate(x, LOWER, UPPER)),
    (("trim", "btrim"), ("STRING",), "STRING", lambda x: F.regexp_replace(x, f"^{BLANK}|{BLANK}$", "")),
    (("ltrim",), ("STRING",), "STRING", lambda x: F.regexp_replace(x, f"^{BLANK}", "")),
    (("rtrim",), ("STRING",), "STRING", lambda x: F.regexp_replace(x, f"{BLANK}$", "")),
    (("length", "char_length"), ("STRING",), "I64", lambda x: F.char_length(x).cast("bigint")),
    (("bit_length",), ("STRING",), "I64", lambda x: F.bit_length(x).cast("bigint")),
    (("ascii",), ("STRING",), "I64", lambda x: F.ascii(x).cast("bigint")),
    (("reverse",), ("STRING",), "STRING", F.reverse),
    (("md5",), ("STRING",), "STRING", lambda x: F.md5(x.cast("binary"))),
    (("contains",), ("STRING", "STRING"), "BOOL", F.contains),
    (("starts_with",), ("STRING", "STRING"), "BOOL", F.startswith),
    (("ends_with",), ("STRING", "STRING"), "BOOL", F.endswith),
    (("strpos",), ("STRING", "STRING"), "I64", lambda x, y: F.instr(x, y).cast("bigint")),
    (("translate",), ("STRING", "STRING", "STRING"), "STRING", lambda x, a, b: F.call_function("translate", x, a, b)),
):
    for _name in _names:
        simple(_name, _kinds, _result, _make)


@function()
def repeat(x: Expr, n: Expr) -> Expr:
    """Empty below 1. A result of more than LONGEST bytes is a row error."""
    expect("repeat", [x, n], "STRING", INT)
    k = F.greatest(small(n), F.lit(0))
    fits = F.octet_length(x.value).cast("bigint") * k <= LONGEST
    return join("STRING", F.when(fits, F.call_function("repeat", x.value, k)), x, n, failed=given(x, n) & ~fits, code="invalid_argument", operation="repeat")


@function()
def initcap(x: Expr) -> Expr:
    """A capital after every character that is no letter or digit."""
    expect("initcap", [x], "STRING")
    words = F.transform(F.regexp_extract_all(x.value, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return join("STRING", F.array_join(words, ""), x)


def side(x: Expr, n: Expr, left: bool) -> Expr:
    expect("left" if left else "right", [x, n], "STRING", INT)
    size, k = F.char_length(x.value), small(n)
    take = F.greatest(F.when(k < 0, size + k).otherwise(F.least(k, size)), F.lit(0))
    return join("STRING", F.substring(x.value, F.lit(1) if left else size - take + 1, take), x, n)


@function()
def left(x: Expr, n: Expr) -> Expr:
    """The first n characters; with n below 0 all but the last -n."""
    return side(x, n, True)


@function()
def right(x: Expr, n: Expr) -> Expr:
    """The last n characters; with n below 0 all but the first -n."""
    return side(x, n, False)


@function("substr", "substring")
def substr(x: Expr, start: Expr, size: Expr | None = None) -> Expr:
    """From a place, which is 1 at least, on."""
    args = [x, start] if size is None else [x, start, size]
    expect("substr", args, "STRING", *[INT] * (len(args) - 1))
    count = F.lit(1 << 30) if size is None else F.greatest(small(size), F.lit(0))
    return join("STRING", F.substring(x.value, F.greatest(small(start), F.lit(1)), count), *args)


@function()
def concat(*args: Expr) -> Expr:
    """Null counts as empty."""
    expect("concat", args, *["STRING"] * max(1, len(args)))
    return join("STRING", F.concat_ws("", *[a.value for a in args]), *args)


@function()
def replace(x: Expr, old: Expr, new: Expr) -> Expr:
    """All places; an empty search puts the new text around every character."""
    expect("replace", [x, old, new], "STRING", "STRING", "STRING")
    around = F.concat(new.value, F.array_join(F.transform(F.split(x.value, ""), lambda c: F.concat(c, new.value)), ""))
    return join("STRING", F.when(old.value == "", F.when(x.value == "", new.value).otherwise(around)).otherwise(F.replace(x.value, old.value, new.value)), x, old, new)


def pad(name: str, x: Expr, n: Expr, fill: Expr) -> Expr:
    expect(name, [x, n, fill], "STRING", INT, "STRING")
    size = F.greatest(small(n), F.lit(0))
    bare = F.when(size == 0, "").otherwise(F.substring(x.value, F.lit(1), size))
    fits = (size <= LONGEST // 4) | (fill.value == "")
    value = F.when(fill.value == "", bare).when(fits, F.call_function(name, x.value, size, fill.value))
    return join("STRING", value, x, n, fill, failed=given(x, n, fill) & ~fits, code="invalid_argument", operation=name)


@function()
def lpad(x: Expr, n: Expr, fill: Expr) -> Expr:
    return pad("lpad", x, n, fill)


@function()
def rpad(x: Expr, n: Expr, fill: Expr) -> Expr:
    return pad("rpad", x, n, fill)


@function()
def split_part(x: Expr, by: Expr, n: Expr) -> Expr:
    """The n-th part; empty below 1 and past the end."""
    expect("split_part", [x, by, n], "STRING", "STRING", INT)
    k = small(n)
    whole = F.when(k == 1, x.value).otherwise("")
    part = F.when(k < 1, F.lit("")).when(by.value == "", whole).otherwise(F.split_part(x.value, by.value, F.greatest(k, F.lit(1))))
    return join("STRING", F.when(given(x, by, n), part), x, by, n)


@function()
def to_hex(x: Expr) -> Expr:
    """Lower-case, two's complement at the type's own width."""
    expect("to_hex", [x], INT)
    if x.type == "U64":
        high, low = F.floor(x.value / F.lit(1 << 32)).cast("bigint"), (x.value % F.lit(1 << 32)).cast("bigint")
        return join("STRING", F.lower(F.when(high == 0, F.hex(low)).otherwise(F.concat(F.hex(high), F.lpad(F.hex(low), 8, "0")))), x)
    bits = int(x.type[1:])
    value = x.value.cast("bigint")
    return join("STRING", F.lower(F.hex(value if bits == 64 else value.bitwiseAND((1 << bits) - 1))), x)


def groups_of(pattern: object) -> int | None:
    """The number of groups of a literal pattern by the JVM's own compiler, or -1 if it is no pattern; None if that can't be told here."""
    context = SparkContext._active_spark_context
    if not isinstance(pattern, str) or context is None:
        return None
    try:
        return context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except (Py4JJavaError, PySparkException):
        return -1


def matching(name: str, kind: str, x: Expr, pattern: Expr, make: Callable[[Column], Column], *more: Expr, fails: Column | None = None) -> Expr:
    """A function of a pattern: a bad pattern is a row error. Literal patterns are checked once, others row by row in the JVM."""
    groups = groups_of(pattern.constant)
    good = F.lit(groups >= 0) if groups is not None else F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern.value).isNotNull()
    good = good if fails is None else good & ~fails
    value = make(pattern.value) if groups is not None and groups >= 0 and fails is None else F.lit(None).cast(T.spark(kind)) if groups == -1 else F.when(good, make(pattern.value))
    sure = groups is not None and groups >= 0 and fails is None
    return join(kind, value, x, pattern, *more, failed=None if sure else given(x, pattern, *more) & ~good, code="invalid_argument", operation=name)


@function()
def regexp_like(x: Expr, pattern: Expr) -> Expr:
    expect("regexp_like", [x, pattern], "STRING", "STRING")
    return matching("regexp_like", "BOOL", x, pattern, lambda p: F.regexp_like(x.value, p))


def template(new: str, groups: int, names: set[str]) -> str:
    """A literal replacement, where $1, $name and ${name} are groups (empty if there is no such group) and $$ a dollar, as the JVM writes it."""

    def one(m: re.Match) -> str:
        if m[0] in {"\\", "$"}:
            return "\\" + m[0]
        if m[0] == "$$":
            return "\\$"
        name = m[1] or m[2]
        if name.isdecimal():
            follows = m.string[m.end() : m.end() + 1]
            return f"${name}" + ("\\" if follows.isdecimal() else "") if int(name) <= groups else ""
        return f"${{{name}}}" if name in names else ""

    return re.sub(r"\$\$|\$(?:\{(\w+)\}|([0-9A-Za-z_]+))|\$|\\", one, new)


@function()
def regexp_replace(x: Expr, pattern: Expr, new: Expr) -> Expr:
    """All matches. In a literal replacement $1, $name and ${name} stand for groups of a literal pattern; in others only $0 does, and further dollars are row errors."""
    expect("regexp_replace", [x, pattern, new], "STRING", "STRING", "STRING")
    groups = groups_of(pattern.constant)
    if groups is not None and isinstance(new.constant, str):
        names = set(re.findall(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern.constant))
        written = F.lit(template(new.constant, groups, names))
        return matching("regexp_replace", "STRING", x, pattern, lambda p: F.regexp_replace(x.value, p, written), new)
    plain = F.replace(new.value, F.lit("\\"), F.lit("\\\\"))
    return matching("regexp_replace", "STRING", x, pattern, lambda p: F.regexp_replace(x.value, p, plain), new, fails=F.replace(new.value, F.lit("$0"), F.lit("")).contains("$"))


@function()
def regexp_substr(x: Expr, pattern: Expr) -> Expr:
    """The first match or null."""
    expect("regexp_substr", [x, pattern], "STRING", "STRING")
    return matching("regexp_substr", "STRING", x, pattern, lambda p: F.regexp_substr(x.value, p))


@function()
def coalesce(*args: Expr) -> Expr:
    if not args or len({a.type for a in args}) > 1:
        raise SchemaError("coalesce takes values of one type")
    return join(args[0].type, F.coalesce(*[a.value for a in args]), *args)


@function()
def is_null(x: Expr) -> Expr:
    return join("BOOL", x.value.isNull(), x)


@function()
def nullif(x: Expr, y: Expr) -> Expr:
    if x.type != y.type:
        raise SchemaError("nullif takes values of one type")
    return join(x.type, F.nullif(x.value, y.value), x, y)


@function()
def abs_(x: Expr) -> Expr:
    """The smallest integer has no absolute value: overflow."""
    expect("abs", [x], T.NUMBERS)
    if x.type[0] != "I":
        return join(x.type, F.abs(x.value), x)
    low = F.lit(T.limits(x.type)[0]).cast(T.spark(x.type))
    value = F.when(x.value != low, F.abs(F.when(x.value != low, x.value)))
    return join(x.type, value, x, failed=given(x) & value.isNull(), code="overflow", operation="abs")


def real(name: str, make: Callable[..., Column], *args: Expr) -> Expr:
    """A function to F64 that stays finite."""
    expect(name, args, *[T.NUMBERS] * len(args))
    value = finite(make(*[a.value.cast("double") for a in args]))
    return join("F64", value, *args, failed=given(*args) & value.isNull(), code="invalid_argument", operation=name)


for _name, _make in (("acos", F.acos), ("asin", F.asin), ("atan", F.atan), ("cos", F.cos), ("exp", F.exp), ("ln", F.ln), ("sqrt", F.sqrt), ("tan", F.tan)):
    FUNCTIONS[_name] = lambda x, name=_name, make=_make: real(name, make, x)
FUNCTIONS["pow"] = FUNCTIONS["power"] = lambda x, y: real("pow", F.pow, x, y)


@function()
def log(x: Expr, y: Expr | None = None) -> Expr:
    """To base 10, or of y to base x."""
    return real("log", F.log10, x) if y is None else real("log", lambda b, v: F.try_divide(F.ln(v), F.ln(b)), x, y)


def rounded(name: str, make: Callable[[Column], Column], x: Expr) -> Expr:
    expect(name, [x], T.NUMBERS)
    return x if x.type in INT else join(x.type, make(x.value.cast("double")).cast(T.spark(x.type)), x)


FUNCTIONS["ceil"] = FUNCTIONS["ceiling"] = lambda x: rounded("ceil", lambda v: F.when(F.abs(v) < 2.0**52, F.ceil(v).cast("double")).otherwise(v), x)
FUNCTIONS["floor"] = lambda x: rounded("floor", lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v), x)
FUNCTIONS["round"] = lambda x: rounded("round", lambda v: F.when(F.abs(v) < 2.0**52, F.signum(v) * F.floor(F.abs(v) + 0.5)).otherwise(v), x)


def items(name: str, x: Expr) -> str:
    kind = T.element(x.type)
    if kind is None:
        raise SchemaError(f"{name} takes a list")
    return kind


@function()
def sum_(x: Expr) -> Expr:
    """Of a list's values that aren't null; null if there are none."""
    kind = items("sum", x)
    if kind not in T.NUMBERS:
        raise SchemaError("sum takes numbers")
    wide = "double" if kind in T.FLOATS else "decimal(38,0)"
    there = F.filter(x.value, lambda v: v.isNotNull())
    total = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0).cast(wide), lambda a, v: (a + v.cast(wide)).cast(wide)))
    value = finite(total).cast(T.spark(kind)) if kind in T.FLOATS else within(total, kind)
    return join(kind, value, x, failed=total.isNotNull() & value.isNull(), code="overflow", operation="sum")


@function()
def count(x: Expr) -> Expr:
    """A list's length, nulls included."""
    items("count", x)
    return join("I64", F.when(x.value.isNotNull(), F.size(x.value)).cast("bigint"), x)


@function()
def first(x: Expr) -> Expr:
    return join(items("first", x), F.get(x.value, 0), x)


@function()
def last(x: Expr) -> Expr:
    return join(items("last", x), F.try_element_at(x.value, F.lit(-1)), x)


@function()
def nth(x: Expr, n: Expr) -> Expr:
    """The n-th from 0 on; null outside."""
    return join(items("nth", x), F.get(x.value, small(n)), x, n)


@function()
def now() -> Expr:
    return Expr(F.current_timestamp(), "DATETIME")


@function()
def uuid_v4() -> Expr:
    return Expr(F.uuid(), "STRING", volatile=True)


@function()
def uuid_v7() -> Expr:
    """48 bits of the clock's milliseconds, then version and random bits."""
    stamp, rest = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0"), F.uuid()
    return Expr(F.concat(F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(rest, 16, 21)), "STRING", volatile=True)


@function()
def leak_sensitive(x: Expr) -> Expr:
    return x.leak()


@function()
def read_header(name: Expr) -> Expr:
    """The first value of a header, from the input's headers column (an array of key and value)."""
    hit = F.filter(F.col("headers"), lambda h: h["key"] == name.value)
    return join("STRING", F.get(hit, 0)["value"], name)


@function()
def read_headers(name: Expr) -> Expr:
    """All values of a header in order."""
    return join("VEC<STRING>", F.transform(F.filter(F.col("headers"), lambda h: h["key"] == name.value), lambda h: h["value"]), name)


def lookup_hash_map(table: DataFrame, table_key: str, key: Expr, wanted: str, order: str) -> Expr:
    """The field of a hash map's entry for a key, compared as text; null without one. Of equal keys the entry of the highest order wins."""
    from millrace.operators.nodes import lookup

    name = f"__map_{next(SERIAL)}"
    joined = lambda df: lookup(df, table.withColumn(name, F.col(wanted)), key.value, table_key, [name], order)
    e = join(T.logical(dict(table.dtypes)[wanted]), F.col(name), key)
    return dataclasses.replace(e, lookups=(*e.lookups, (name, joined)))


def array(*args: Expr) -> Expr:
    """A list of values of one type."""
    if not args or len({a.type for a in args}) > 1:
        raise SchemaError("an array takes values of one type")
    return join(f"ARRAY<{args[0].type},{len(args)}>", F.array(*[a.value for a in args]), *args)


def case(*arms: tuple[Expr, Expr], other: Expr | None = None, of: Expr | None = None) -> Expr:
    """The first arm whose condition holds, or equals `of`; null without a match. Only errors of conditions tried and of the arm taken count."""
    kinds = {v.type for _, v in arms} | ({other.type} if other else set())
    if len(kinds) != 1:
        raise SchemaError("all arms have one type")
    tests = [of.eq(c) if of is not None else c for c, _ in arms]
    if any(t.type != "BOOL" for t in tests):
        raise SchemaError("conditions are BOOL")
    parts = [*tests, *[v for _, v in arms], *([other] if other else [])]
    value = other.value if other else F.lit(None).cast(T.spark(next(iter(kinds))))
    error = other.error if other else None
    for test, (_, result) in zip(reversed(tests), reversed(arms), strict=True):
        value = F.when(test.value, result.value).otherwise(value)
        if result.error is not None or error is not None:
            taken = F.when(test.value, F.lit(None).cast("int") if result.error is None else result.error)
            error = taken if error is None else taken.otherwise(error)
        error = first_error([e for e in (test.error, error) if e is not None])
    return replace_error(join(next(iter(kinds)), value, *parts), error)


def replace_error(e: Expr, error: Column | None) -> Expr:
    return dataclasses.replace(e, error=error)


def if_(test: Expr, yes: Expr, no: Expr | None = None) -> Expr:
    return case((test, yes), other=no)


RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """What make gives for a value that is written, and computed, once however often make uses it."""
    return F.get(F.transform(F.array(value), make), 0)


def plain_number(x: Column) -> Column:
    """A float's shortest digits without exponent and without a zero fraction."""

    def spread(v: Column) -> Column:
        digits, power = v["digits"], v["power"]
        below = F.concat(F.lit("0."), F.call_function("repeat", F.lit("0"), -power - 1), digits)
        above = F.concat(F.rpad(digits, power + 1, F.lit("0")), F.when(F.char_length(digits) > power + 1, F.concat(F.lit("."), F.substring(digits, power + 2, F.char_length(digits)))).otherwise(""))
        return F.when(power < 0, below).otherwise(above)

    def written(text: Column) -> Column:
        digits = F.rtrim(F.translate(F.substring_index(text, "E", 1), "-.", ""), F.lit("0"))
        parts = F.struct(digits.alias("digits"), F.substring_index(text, "E", -1).try_cast("int").alias("power"))
        large = F.concat(F.when(text.startswith("-"), "-").otherwise(""), once(parts, spread))
        whole = F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.char_length(text) - 2)).otherwise(text)
        return F.when(text.contains("E"), large).when(text.endswith("Infinity"), F.replace(text, F.lit("Infinity"), F.lit("inf"))).otherwise(whole)

    return once(x.cast("string"), written)


def cast(x: Expr, to: str) -> Expr:
    """x AS type. What can't be cast becomes null and a row error."""
    if x.type == to:
        return x
    a, spark = x.value, T.spark(to)
    if to == "STRING":
        if x.type in T.FLOATS:
            value = plain_number(a)
        elif x.type == "DATETIME":
            value = F.concat(F.regexp_replace(F.date_format(a, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("+00:00"))
        else:
            value = a.cast("string")
    elif x.type == "STRING":
        if to == "DATETIME":
            value = F.when(a.rlike(RFC3339), F.try_to_timestamp(a))
        elif to == "BOOL":
            value = F.when(a.isin("true", "false"), a == "true")
        elif to in INT:
            value = within(F.regexp_extract(a, r"^[+-]?\d{1,20}$", 0).try_cast("decimal(38,0)"), to)
        else:
            value = finite(F.regexp_extract(a, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", 0).try_cast("double").cast(spark)).cast(spark)
    elif x.type in T.FLOATS and to in INT:
        size = F.abs(a.cast("double"))
        high = F.floor(size / 2.0**32)  # exact, as is the rest: no digit is lost on the way through decimals
        whole = F.when(size < 1e20, high.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.floor(size - high * 2.0**32).cast("decimal(10,0)"))
        value = within(F.when(a < 0, -whole).otherwise(whole), to)
    elif x.type == "DATETIME" and to in INT:
        value = within(F.unix_micros(a).cast("decimal(38,0)") * 1000, to)
    elif x.type in INT and to == "DATETIME":
        value = F.timestamp_micros(F.floor(a.cast("decimal(38,0)") / 1000).cast("bigint"))
    elif x.type == "BOOL" and to in T.NUMBERS:
        value = a.cast("int").cast(spark)
    elif to == "BOOL" and x.type in T.NUMBERS:
        value = a != 0
    elif to in INT:
        value = within(a, to)
    elif to in T.FLOATS and x.type in T.NUMBERS:
        value = finite(a.cast(spark)).cast(spark)
    else:
        raise SchemaError(f"no cast from {x.type} to {to}")
    return join(to, value, x, failed=given(x) & value.isNull(), code="cast_failed", operation=to)


def udf(name: str, body: Callable[..., pd.Series], args: tuple[str, ...], returns: str, optional: tuple[bool, ...] = (), volatile: bool = False) -> Callable[..., Expr]:
    """Register a vectorised user function of 1 to 8 arguments. Rows with null in an argument that isn't optional give
    null without its seeing them; a row for which it gives null, or raises, is an error. A batch that raises is tried again row by row."""
    if not 1 <= len(args) <= 8:
        raise SchemaError("a user function takes 1 to 8 arguments")
    spared = [k for k in range(len(args)) if not (optional[k] if k < len(optional) else False)]

    def run(*series: pd.Series) -> pd.Series:
        there = pd.Series(True, index=series[0].index)
        for k in spared:
            there &= series[k].notna()
        out = pd.Series([None] * len(there), index=there.index, dtype=object)
        if there.any():
            try:
                out[there] = body(*[s[there] for s in series])
            except Exception:  # noqa: BLE001 - whatever a user's code raises is an error of those rows, not of the job
                for k in np.flatnonzero(there.to_numpy()):
                    out.iloc[k] = alone(*[s.iloc[[k]] for s in series])
        return out

    def alone(*series: pd.Series) -> object:
        try:
            return pd.Series(body(*series)).iloc[0]
        except Exception:  # noqa: BLE001
            return None

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    vectorised = F.pandas_udf(run, T.spark(returns))
    if volatile:
        vectorised = vectorised.asNondeterministic()

    def f(*given_args: Expr) -> Expr:
        expect(name, given_args, *args)
        value = vectorised(*[a.value for a in given_args])
        return join(returns, value, *given_args, failed=given(*[given_args[k] for k in spared]) & value.isNull(), code="invalid_argument", operation=name)

    FUNCTIONS[f"udf::{name}"] = f
    return f
