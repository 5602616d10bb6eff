"""NOT NULL and PRIMARY KEY, checked as jobs over a loaded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from concordat.functions.sql import aggregate, literal, quoted, struct, unpivot
from concordat.sources.schema_files import primary_key, required_columns


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows) for required columns that hold nulls; one pass for all columns."""
    index = dict(enumerate(columns))
    counts = aggregate(df, [], {f"n{i}": f"count_if({quoted(c)} IS NULL)" for i, c in index.items()})
    return unpivot(counts, [], [struct(column=literal(c), n_rows=f"n{i}") for i, c in index.items()]).where("n_rows > 0")


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """(key columns..., n_rows) for keys that occur more than once. The count combines
    before the shuffle, so one heavily repeated key stays one row per task."""
    return aggregate(df, key, {"n_rows": "count(1)"}).where("n_rows > 1")


def constraint_violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(constraint, column, key, n_rows); no rows means the table satisfies its schema."""
    key = primary_key(schema)
    required = sorted(set(required_columns(schema)) | set(key), key=schema.names.index)
    parts = []
    if required:
        gaps = null_violations(df, required)
        parts.append(gaps.selectExpr("'not_null' AS constraint", "`column`", "CAST(NULL AS string) AS key", "n_rows"))
    if key:
        # A mark or backslash inside a value is escaped, so no two keys are shown alike; a null is \N.
        text = lambda k: f"replace(replace(CAST({quoted(k)} AS string), {literal(chr(92))}, {literal(chr(92) * 2)}), '|', {literal(chr(92) + '|')})"
        shown = ", ".join(f"coalesce({text(k)}, {literal(chr(92) + 'N')})" for k in key)
        parts.append(
            key_violations(df, key).selectExpr(
                "'primary_key' AS constraint", f"{literal(','.join(key))} AS `column`", f"concat_ws('|', {shown}) AS key", "n_rows"
            )
        )
    if not parts:
        return df.sparkSession.createDataFrame([], "constraint string, column string, key string, n_rows bigint")
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
