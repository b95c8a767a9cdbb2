"""JSON and XML payloads to and from typed columns, by Spark's own parsers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import types as T
from millrace.functions.expr import Expr, within
from millrace.functions.scalar import RFC3339, cast
from millrace.operators.route import Field, Routed, spark_schema


def typed(value: Column, f: Field) -> Column:
    """A variant as the field's type, or null if it is of another: lists hold elements of exactly their type, and arrays as many as they say."""
    kind = F.schema_of_variant(value)
    inner = T.element(f.type)
    if inner is not None:
        parts = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
        made = F.transform(parts, lambda v: typed(v, Field(inner)))
        exact = ~F.exists(made, lambda v: v.isNull())
        size = T.length(f.type)
        return F.when(exact if size is None else exact & (F.size(parts) == size), made)
    if f.type == "STRING":
        return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    if f.type == "BOOL":
        return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
    if f.type == "DATETIME":
        text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))
    if f.type in T.INTEGERS:
        return within(F.when(kind.isin("BIGINT") | kind.like("DECIMAL(%,0)"), F.try_variant_get(value, "$", "decimal(38,0)")), f.type)
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.like("DECIMAL%"), F.try_variant_get(value, "$", T.spark(f.type)))


def decode_json(df: DataFrame, payload: str, fields: Mapping[str, Field], strict: bool = True) -> Routed:
    """Objects with the fields, typed exactly. Payloads that aren't objects, lack a required field, hold a value of another
    type or out of range, or (strict) an unknown field, are in errors; loose decoding drops unknown fields."""
    parsed = df.withColumn("__doc", F.try_parse_json(payload)).withColumn("__keys", F.json_object_keys(payload))
    good = F.col("__keys").isNotNull() & F.col("__doc").isNotNull()
    if strict:
        good = good & (F.size(F.array_except("__keys", F.array(*[F.lit(n) for n in fields]))) == 0)
    values = {}
    for name, f in fields.items():
        quoted = f"'{name}'" if "'" not in name else f'"{name}"'
        raw = F.try_variant_get("__doc", f"$[{quoted}]", "variant")
        missing = raw.isNull() | F.is_variant_null(raw)
        values[name] = F.when(~missing, typed(raw, f))
        good = good & (missing if f.optional else F.lit(False)) | good & values[name].isNotNull()
    good = F.coalesce(good, F.lit(False))
    marked = parsed.withColumn("__good", good)
    rest = [c for c in df.columns if c not in fields]
    return Routed(marked.filter("__good").select(*rest, *[v.alias(n) for n, v in values.items()]), marked.filter("NOT __good").select(*df.columns))


def encode_json(df: DataFrame, fields: Sequence[str]) -> Column:
    """An object of the fields; null ones are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in fields]), {"ignoreNullFields": "true"})


def decode_xml(df: DataFrame, payload: str, fields: Mapping[str, Field], row_tag: str = "row", strict: bool = True) -> Routed:
    """XML elements with the fields as children, whose texts must be of their types. What isn't well formed, lacks a required field, holds a
    value of another type, or (strict) an element of another name, is in errors; loose decoding drops unknown elements."""
    text = {n: Field(f"VEC<{'STRING'}>" if T.element(f.type) else "STRING") for n, f in fields.items()}
    parsed = df.withColumn("__row", F.from_xml(payload, f"{spark_schema(text)}, `__bad` string", {"rowTag": row_tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    good = F.col("__row").isNotNull() & F.col("__row.__bad").isNull() & F.col(payload).rlike(rf"(?s)^\s*(<\?.*?\?>\s*)?<{re.escape(row_tag)}[\s/>]")
    if strict:
        bare = F.regexp_replace(payload, r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->", "")
        names = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"<([\p{L}_][^\s/>]*)"), F.lit(1)))
        good = good & (F.size(F.array_except(names, F.array(*[F.lit(n) for n in [row_tag, *fields]]))) == 0)
    values = {}
    for name, f in fields.items():
        said, inner = F.col(f"__row.`{name}`"), T.element(f.type)
        if inner is None:
            values[name] = cast(Expr(said, "STRING"), f.type).value
        else:
            made = F.transform(said, lambda v, inner=inner: cast(Expr(v, "STRING"), inner).value)
            exact = ~F.exists(made, lambda v: v.isNull())
            values[name] = F.when(exact if T.length(f.type) is None else exact & (F.size(said) == T.length(f.type)), made)
        good = good & (values[name].isNotNull() | (said.isNull() if f.optional else F.lit(False)))
    marked = parsed.withColumn("__good", F.coalesce(good, F.lit(False)))
    rest = [c for c in df.columns if c not in fields]
    return Routed(marked.filter("__good").select(*rest, *[v.alias(n) for n, v in values.items()]), marked.filter("NOT __good").select(*df.columns))
