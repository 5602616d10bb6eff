"""Two tables side by side.

Every check that compares the two sides is one pass over their union: a row carries the
side it came from, and a grouped aggregate with per-side conditions replaces the full
outer join. It shuffles partial aggregates only, keeps null keys as a group, and a key
that holds a third of the rows is one row per map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from concordat.functions.sql import aggregate, quoted
from concordat.functions.types import comparison_type, holds_map, is_numeric, sorted_maps

IS_SOURCE = "__is_source"
FROM_SOURCE, FROM_TARGET = IS_SOURCE, f"NOT {IS_SOURCE}"


@dataclass(frozen=True)
class Pair:
    source: DataFrame
    target: DataFrame
    schema: T.StructType

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def dtype(self, column: str) -> T.DataType:
        return self.schema[column].dataType

    def subset(self, columns: list[str]) -> "Pair":
        fields = [self.schema[c] for c in columns]
        chosen = [quoted(c) for c in columns]
        return Pair(self.source.selectExpr(*chosen), self.target.selectExpr(*chosen), T.StructType(fields))

    def numeric_columns(self) -> list[str]:
        return [f.name for f in self.schema.fields if is_numeric(f.dataType)]

    def typed(self, columns: list[str] | None = None) -> list[tuple[str, T.DataType]]:
        return [(quoted(c), self.dtype(c)) for c in columns or self.columns]

    def tagged(self, *expressions: str) -> DataFrame:
        """Both sides' rows with ``__is_source`` and the given SQL expressions (all columns
        by default)."""
        chosen = expressions or [quoted(c) for c in self.columns]
        return self.source.selectExpr(f"true AS {IS_SOURCE}", *chosen).unionAll(
            self.target.selectExpr(f"false AS {IS_SOURCE}", *chosen)
        )


def source_only(pair: Pair) -> Pair:
    """For what is known to be the same on both sides: the target's scan is pruned away."""
    return Pair(pair.source, pair.target.where("false"), pair.schema)


def as_doubles(pair: Pair, columns: list[str]) -> Pair:
    """The pair with some numeric columns as doubles, for columns whose values a double holds
    exactly: one type means one pass where operators work type by type."""
    chosen = [f"CAST({quoted(c)} AS double) AS {quoted(c)}" if c in columns else quoted(c) for c in pair.columns]
    fields = [T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in pair.schema.fields]
    return Pair(pair.source.selectExpr(*chosen), pair.target.selectExpr(*chosen), T.StructType(fields))


def both_sides(long: DataFrame, by: list[str], values: dict[str, str], default: str | None = None) -> DataFrame:
    """Bring the rows of the two sides onto one: ``values`` maps a column to the stem of its
    new names (``source_<stem>``, ``target_<stem>``); ``default`` stands in for an absent side."""
    aggs = {}
    for column, stem in values.items():
        for tag, side in (("source", FROM_SOURCE), ("target", FROM_TARGET)):
            value = f"max(CASE WHEN {side} THEN {quoted(column)} END)"
            aggs[f"{tag}_{stem}"] = value if default is None else f"coalesce({value}, {default})"
    return aggregate(long, by, aggs)


def align(source: DataFrame, target: DataFrame) -> Pair:
    """Common columns in name order, cast to one type; NaN is null, as a missing value."""
    left, right = source.schema, target.schema
    common = sorted(set(left.names) & set(right.names))
    wanted = {c: comparison_type(left[c].dataType, right[c].dataType) for c in common}

    def cast(df: DataFrame, schema: T.StructType) -> DataFrame:
        out = []
        for name, want in wanted.items():
            has, c = schema[name].dataType, quoted(name)
            if holds_map(has):
                c = f"to_json({sorted_maps(c, has)})"
            elif has != want:
                c = f"CAST({c} AS {want.simpleString()})"
            if isinstance(want, (T.DoubleType, T.FloatType)):
                c = f"nanvl({c}, CAST(NULL AS {want.simpleString()}))"
            out.append(f"{c} AS {quoted(name)}")
        return df.selectExpr(*out)

    schema = T.StructType([T.StructField(name, want) for name, want in wanted.items()])
    return Pair(cast(source, left), cast(target, right), schema)
