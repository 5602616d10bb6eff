"""Declared type tokens, type families and the type two columns are compared in."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import types as T

# Declared type token -> (Spark type, comparison family).
TYPE_TOKENS: dict[str, tuple[T.DataType, str]] = {
    "varchar": (T.StringType(), "string"),
    "text": (T.StringType(), "string"),
    "string": (T.StringType(), "string"),
    "char": (T.StringType(), "string"),
    "nvarchar": (T.StringType(), "string"),
    "clob": (T.StringType(), "string"),
    "int": (T.IntegerType(), "integer"),
    "integer": (T.IntegerType(), "integer"),
    "bigint": (T.LongType(), "integer"),
    "smallint": (T.IntegerType(), "integer"),
    "tinyint": (T.IntegerType(), "integer"),
    "bool": (T.BooleanType(), "boolean"),
    "boolean": (T.BooleanType(), "boolean"),
    "float": (T.DoubleType(), "float"),
    "double": (T.DoubleType(), "float"),
    "real": (T.DoubleType(), "float"),
    "numeric": (T.DoubleType(), "float"),
    "decimal": (T.DoubleType(), "float"),
    "date": (T.DateType(), "date"),
    "datetime": (T.TimestampNTZType(), "datetime"),
    "timestamp": (T.TimestampNTZType(), "datetime"),
}

_TOKEN_SHAPE = re.compile(r"\s*([^(]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\).*)?(?:\(.*)?", re.S)


def parse_type_token(declared: str, column: str = "") -> tuple[T.DataType, str]:
    """``VARCHAR(255)`` -> (StringType, "string"); an unknown token warns and becomes text."""
    word, precision, scale = _TOKEN_SHAPE.fullmatch(declared).groups()
    word = word.lower()
    if word not in TYPE_TOKENS:
        warnings.warn(f"column '{column}': type '{declared}' is not known, using text", stacklevel=3)
        return T.StringType(), "string"
    if word in ("numeric", "decimal") and precision:
        return T.DecimalType(int(precision), int(scale or 0)), "float"
    return TYPE_TOKENS[word]


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return dtype.simpleString()


def is_numeric(dtype: T.DataType) -> bool:
    return family(dtype) in ("integer", "float")


def comparison_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type both columns are cast to before values are compared.

    Integers widen to bigint and decimals to a common scale, so a rewrite that only
    changed the width of a column still compares equal.
    """
    fa, fb = family(a), family(b)
    if fa == fb == "integer":
        return T.LongType()
    if fa == fb == "float" and isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        if whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
        return T.DoubleType()
    if fa in ("integer", "float") and fb in ("integer", "float"):
        return a if a == b and not isinstance(a, T.FloatType) else T.DoubleType()
    if fa == fb == "datetime":
        return T.TimestampNTZType()
    if fa == fb and fa in ("string", "boolean", "date"):
        return a
    return a if a == b and not holds_map(a) else T.StringType()


def holds_map(dtype: T.DataType) -> bool:
    """Maps have no order and no equality in Spark; a value with one inside is compared as JSON."""
    if isinstance(dtype, T.StructType):
        return any(holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType) or isinstance(dtype, T.ArrayType) and holds_map(dtype.elementType)


def sorted_maps(c: str, dtype: T.DataType, depth: int = 0) -> str:
    """The value with every map as the array of its entries in key order (SQL text)."""
    x = f"x{depth}"
    if isinstance(dtype, T.MapType):
        entry = f"struct({x}.key AS key, {sorted_maps(f'{x}.value', dtype.valueType, depth + 1)} AS value)"
        by_key = "(l, r) -> CASE WHEN l.key < r.key THEN -1 WHEN l.key > r.key THEN 1 ELSE 0 END"
        return f"transform(array_sort(map_entries({c}), {by_key}), {x} -> {entry})"
    if isinstance(dtype, T.ArrayType) and holds_map(dtype):
        return f"transform({c}, {x} -> {sorted_maps(x, dtype.elementType, depth + 1)})"
    if isinstance(dtype, T.StructType) and holds_map(dtype):
        fields = ", ".join(f"{sorted_maps(f'{c}.`{f.name}`', f.dataType, depth)} AS `{f.name}`" for f in dtype.fields)
        return f"CASE WHEN {c} IS NOT NULL THEN struct({fields}) END"
    return c
