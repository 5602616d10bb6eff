"""Columns as numbers, exact sums, and when two numbers count as equal (SQL text)."""

from __future__ import annotations

from pyspark.sql import types as T

from concordat.functions.cells import strip_text, to_number
from concordat.functions.types import family, is_numeric


def as_number(c: str, dtype: T.DataType) -> str:
    """Numeric columns as they are; text read as a double, null where it is no numeral."""
    return c if is_numeric(dtype) else to_number(strip_text(f"CAST({c} AS string)"))


def summable(c: str, dtype: T.DataType) -> str:
    """Integers widen to decimal: a bigint sum over 10**12 rows can overflow."""
    return f"CAST({c} AS decimal(28,0))" if family(dtype) == "integer" else as_number(c, dtype)


def relative_base(a: str) -> str:
    """The magnitude a difference is measured against; zero counts as one."""
    return f"(CASE WHEN {a} = 0 THEN 1D ELSE CAST(abs({a}) AS double) END)"


def absolute_diff(a: str, b: str) -> str:
    """Equal values differ by 0, infinities among them; an infinity differs from others without bound."""
    return f"CASE WHEN {a} = {b} THEN 0D ELSE CAST(abs({a} - {b}) AS double) END"


def relative_diff(a: str, b: str) -> str:
    """Infinity over infinity would be no number: a difference without bound stays without bound."""
    return f"CASE WHEN isnan({_ratio(a, b)}) THEN double('infinity') ELSE {_ratio(a, b)} END"


def _ratio(a: str, b: str) -> str:
    return f"(({absolute_diff(a, b)}) / {relative_base(a)})"


def within_tolerance(a: str, b: str, absolute: str | float, relative: str | float) -> str:
    """Both null agree, one null does not; otherwise either bound is enough."""
    absolute, relative = (x if isinstance(x, str) else f"{float(x)!r}D" for x in (absolute, relative))
    return (
        f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false "
        f"ELSE {absolute_diff(a, b)} <= {absolute} OR {relative_diff(a, b)} <= {relative} END"
    )
