"""Typed expressions and the scalar functions on them."""

from millrace.functions.expr import ERROR, Expr, SchemaError, field, lit, null, of_table
from millrace.functions.scalar import FUNCTIONS, array, call, case, cast, if_, lookup_hash_map, udf

__all__ = ["ERROR", "FUNCTIONS", "Expr", "SchemaError", "array", "call", "case", "cast", "field", "if_", "lit", "lookup_hash_map", "null", "of_table", "udf"]
