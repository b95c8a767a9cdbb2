"""Logical types and the Spark types that hold them."""

from __future__ import annotations

import re

#: Logical type -> Spark type. Unsigned types are held by the next wider signed one and range-checked.
SPARK = {
    "U8": "smallint", "U16": "int", "U32": "bigint", "U64": "decimal(20,0)", "I8": "tinyint", "I16": "smallint", "I32": "int", "I64": "bigint",
    "F32": "float", "F64": "double", "BOOL": "boolean", "STRING": "string", "DATETIME": "timestamp",
}
INTEGERS = ("U8", "U16", "U32", "U64", "I8", "I16", "I32", "I64")
FLOATS = ("F32", "F64")
NUMBERS = INTEGERS + FLOATS
FROM_SPARK = {"tinyint": "I8", "smallint": "I16", "int": "I32", "bigint": "I64", "float": "F32", "double": "F64", "boolean": "BOOL", "string": "STRING", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME"}


def limits(kind: str) -> tuple[int, int]:
    """Smallest and largest value of an integer type."""
    bits = int(kind[1:])
    return (0, 2**bits - 1) if kind[0] == "U" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)


def element(kind: str) -> str | None:
    """Element type of VEC<T> or ARRAY<T,n>, else None. ARRAY<T,n,m> holds n of ARRAY<T,m>."""
    m = re.fullmatch(r"VEC<(.+)>|ARRAY<(.+?),\d+((?:,\d+)*)>", kind)
    return None if not m else m[1] or (f"ARRAY<{m[2]}{m[3]}>" if m[3] else m[2])


def length(kind: str) -> int | None:
    """The exact length of an ARRAY, else None."""
    m = re.fullmatch(r"ARRAY<.+?,(\d+)(?:,\d+)*>", kind)
    return int(m[1]) if m else None


def spark(kind: str) -> str:
    inner = element(kind)
    return f"array<{spark(inner)}>" if inner else SPARK[kind]


def logical(spark_type: str) -> str:
    """Logical type of a Spark type; arrays are VEC."""
    if m := re.fullmatch(r"array<(.+)>", spark_type):
        return f"VEC<{logical(m[1])}>"
    if spark_type not in FROM_SPARK:
        raise TypeError(f"no logical type for {spark_type}")
    return FROM_SPARK[spark_type]
