"""Expressions as SQL text.

A table with hundreds of columns needs thousands of expressions, and every ``Column`` call
is several round trips to the JVM. Written as text, a whole projection or aggregate goes
over in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str | None) -> str:
    if text is None:
        return "NULL"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def struct(**fields: str) -> str:
    return "struct(" + ", ".join(f"{e} AS {quoted(name)}" for name, e in fields.items()) + ")"


def unpivot(df: DataFrame, keep: list[str], rows: list[str]) -> DataFrame:
    """One output row per struct in ``rows`` for every input row; no shuffle."""
    return df.selectExpr(*keep, f"inline(array({', '.join(rows)}))")


def aggregate(df: DataFrame, keys: list[str], aggs: dict[str, str]) -> DataFrame:
    """GROUP BY ``keys`` (names, unquoted) with named aggregates; no keys is the whole table."""
    quoted_keys = [quoted(k) for k in keys]
    return df.groupBy(*quoted_keys).agg(F.expr(struct(**aggs)).alias("__a")).select(*quoted_keys, "__a.*")
