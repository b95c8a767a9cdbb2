"""Routes: one output of a node. Fields are inherited and set in order, the message is finalised, filtered, and rows with errors leave on their own path.

Assignments are functions from the message so far (a dict of expressions by name) to an expression.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import types as T
from millrace.functions.expr import Expr, SchemaError, expanded, first_error, null

Message = Mapping[str, Expr]
Make = Callable[[Message], Expr]


@dataclass(frozen=True)
class Field:
    """A field of an output schema."""

    type: str
    optional: bool = False
    sensitive: bool = False


@dataclass(frozen=True)
class Route:
    """inherit: "all", names, or ("except", names). set: ordered (name, function). errors: None drops rows with errors, else the error route's own sets, which see
    the input's fields, error_code, error_operation, and what was set as partial_<name>."""

    schema: Mapping[str, Field]
    set: tuple[tuple[str, Make], ...] = ()
    inherit: str | tuple = ()
    where: Make | None = None
    errors: tuple[tuple[str, Make], ...] | None = None


@dataclass
class Routed:
    rows: DataFrame
    errors: DataFrame | None = field(default=None)


def inherited(message: Message, route: Route) -> dict[str, Expr]:
    """The fields that are copied: of the same name and exactly the same type."""
    names = route.inherit
    if names == "all":
        names = [n for n in route.schema if n in message]
    elif names and names[0] == "except":
        names = [n for n in route.schema if n in message and n not in names[1]]
    for name in names:
        if name not in message or name not in route.schema or message[name].type != route.schema[name].type:
            raise SchemaError(f"{name} can't be inherited: another type, or not there")
    return {n: message[n] for n in names}


def finalised(out: Mapping[str, Expr], route: Route) -> dict[str, Expr]:
    """Every field of the schema: optional ones that weren't set are null."""
    done = {}
    for name, f in route.schema.items():
        if name not in out and not f.optional:
            raise SchemaError(f"{name} is required and not set")
        done[name] = out.get(name) or null(f.type)
        if done[name].type != f.type:
            raise SchemaError(f"{name} is {f.type}, not {done[name].type}")
        if done[name].sensitive and not f.sensitive:
            raise SchemaError(f"{name} would leak a sensitive value")
    return done


def apply(df: DataFrame, message: Message, route: Route, keep: tuple[str, ...] = ()) -> Routed:
    """Rows of one route, and those of its error route. keep: further columns that pass through. Every assignment is a projection of
    its own, which Catalyst joins where that repeats no work."""
    out, errors, staged = inherited(message, route), [], df

    def stage(e: Expr, name: str) -> Expr:
        nonlocal staged
        for column, look in e.lookups:
            staged = staged if column in staged.columns else look(staged)
        staged = staged.withColumns({name: e.value} | ({f"{name}_error": e.error} if e.error is not None else {}))
        if e.error is not None:
            errors.append(F.col(f"{name}_error"))
        return Expr(F.col(name), e.type, sensitive=e.sensitive)

    for k, (name, make) in enumerate(route.set):
        if name not in route.schema:
            raise SchemaError(f"the output has no field {name}")
        out[name] = stage(make({**message, **out}), f"__set_{k}")
    done = finalised(out, route)
    keys = {n: f"__out_{k}" for k, n in enumerate(done)}
    staged = staged.withColumns({keys[n]: e.value for n, e in done.items()})
    done = {n: Expr(F.col(keys[n]), e.type, sensitive=e.sensitive) for n, e in done.items()}
    passes = stage(route.where(done), "__where").value if route.where else F.lit(True)
    select = [*[F.col(k) for k in keep], *[e.value.alias(n) for n, e in done.items()]]
    if not errors:
        return Routed((staged.filter(passes) if route.where else staged).select(*select))
    staged = staged.withColumn("__error", first_error(errors))
    rows = staged.filter(F.col("__error").isNull() & passes).select(*select)
    if route.errors is None:
        return Routed(rows)
    entry = expanded(F.col("__error"))
    seen = {**message, "error_code": Expr(entry["code"], "STRING"), "error_operation": Expr(entry["operation"], "STRING"), **{f"partial_{n}": e for n, e in done.items()}}
    sent: dict[str, Expr] = {}
    for name, make in route.errors:
        sent[name] = make({**seen, **sent})
        if sent[name].lookups:
            raise SchemaError("an error route has no lookups")
    bad = staged.filter(F.col("__error").isNotNull())
    return Routed(rows, bad.select(*[F.col(k) for k in keep], *[e.value.alias(n) for n, e in sent.items()]))


def schema(**kinds: str) -> dict[str, Field]:
    """An output schema: name="I64", a ? at the end for optional, a ! for sensitive."""
    return {n: Field(k.rstrip("?!"), "?" in k, "!" in k) for n, k in kinds.items()}


def spark_schema(fields: Mapping[str, Field]) -> str:
    return ", ".join(f"`{n}` {T.spark(f.type)}" for n, f in fields.items())


ALTERATIONS = ("add", "drop", "rename", "type", "optional", "sensitive")


def altered(fields: Mapping[str, Field], *steps: tuple) -> dict[str, Field]:
    """A schema after ordered steps ("add", name, Field) ("drop", name) ("rename", old, new) ("type", name, kind) ("optional", name, bool) ("sensitive", name, bool); all or none."""
    out = dict(fields)
    for step, name, *rest in steps:
        if step not in ALTERATIONS or (name in out) == (step == "add"):
            raise SchemaError(f"can't {step} {name}")
        if step == "add":
            out[name] = rest[0]
        elif step == "drop":
            if len(out) == 1:
                raise SchemaError("the last field stays")
            del out[name]
        elif step == "rename":
            if rest[0] in out:
                raise SchemaError(f"{rest[0]} is there already")
            out = {rest[0] if n == name else n: f for n, f in out.items()}
        else:
            old = out[name]
            out[name] = Field(rest[0] if step == "type" else old.type, rest[0] if step == "optional" else old.optional, rest[0] if step == "sensitive" else old.sensitive)
    return out
