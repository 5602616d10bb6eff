"""Distinct non-null values per column on both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from concordat.functions.sql import aggregate, literal, quoted, struct, unpivot
from concordat.operators.pairing import FROM_SOURCE, FROM_TARGET, IS_SOURCE, Pair, both_sides


def _deviation(both: DataFrame, tolerance: float) -> DataFrame:
    return both.selectExpr("*", "abs(source_cardinality - target_cardinality) AS delta").selectExpr(
        "*", f"delta / greatest(source_cardinality, 1) > {float(tolerance)!r}D AS deviates"
    )


def cardinality(pair: Pair, tolerance: float = 0.01, rsd: float | None = None) -> DataFrame:
    """(column, source_cardinality, target_cardinality, delta, deviates).

    Exact: each (column, value) is one row whose sides are two flags, folded in the map
    tasks before the shuffle, so a frequent value costs one row per task. Columns of one
    type share a pass and are grouped in that type, so a pass reads only its own columns
    and builds no text. Several ``count(distinct)`` in one aggregate would instead copy each
    input row once per column. ``rsd`` switches to sketches, which shuffle a fixed size
    whatever the data; keep it well below ``tolerance``.
    """
    index = {i: c for i, c in enumerate(pair.columns)}
    if rsd is not None:
        sketches = {f"n{i}": f"approx_count_distinct({quoted(c)}, {rsd})" for i, c in index.items()}
        sides = aggregate(pair.tagged(), [IS_SOURCE], sketches)
        rows = [struct(column=literal(c), n=f"n{i}") for i, c in index.items()]
        both = both_sides(unpivot(sides, [IS_SOURCE], rows), ["column"], {"n": "cardinality"}, default="0")
        return _deviation(both, tolerance)
    by_type: dict[T.DataType, list[int]] = {}
    for i, c in index.items():
        by_type.setdefault(pair.dtype(c), []).append(i)
    counts = []
    for dtype, members in by_type.items():
        # Adding zero folds -0.0 into 0.0, which are one value.
        value = (lambda c: f"{c} + 0D") if isinstance(dtype, T.DoubleType) else (lambda c: c)
        cells = [struct(c=str(i), value=value(quoted(index[i]))) for i in members]
        values = unpivot(pair.tagged(*[quoted(index[i]) for i in members]), [IS_SOURCE], cells).where("value IS NOT NULL")
        distinct = aggregate(values, ["c", "value"], {"s": f"bool_or({FROM_SOURCE})", "t": f"bool_or({FROM_TARGET})"})
        counts.append(aggregate(distinct, ["c"], {"sn": "count_if(s)", "tn": "count_if(t)"}))
    counted = reduce(DataFrame.unionAll, counts)
    # A column without a value on either side has no row yet; a constant row for each adds it.
    named = pair.source.sparkSession.range(1).selectExpr(
        f"inline(array({', '.join(struct(c=str(i), column=literal(c)) for i, c in index.items())}))"
    )
    both = named.join(counted, "c", "left").selectExpr(
        quoted("column"), "coalesce(sn, 0) AS source_cardinality", "coalesce(tn, 0) AS target_cardinality"
    )
    return _deviation(both, tolerance)
