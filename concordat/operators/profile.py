"""One pass over both sides for everything a plain aggregate can answer.

The same job feeds the row count, null counts and ratios, grand totals and the moments of
the statistical profile. Percentiles come from operators/order_stats.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from concordat.functions.numbers import as_number, relative_diff, summable
from concordat.functions.sql import aggregate, literal, quoted, struct, unpivot
from concordat.operators.order_stats import column_percentiles, percentile_name
from concordat.operators.pairing import IS_SOURCE, Pair, both_sides

MOMENTS = ["min", "max", "mean", "stddev"]
# Shown in a profile; they have checks of their own, so deviations leave them out.
COUNTS = ["non_null", "null_ratio"]


def side_profile(pair: Pair, coerced: list[str] | None = None, moments: bool = True) -> DataFrame:
    """Rows (is_source, column, is_numeric, rows, non_null, nulls, numbers, total, min, max,
    mean, stddev, null_ratio). Moments are null for columns that are neither numeric nor in
    ``coerced`` (text columns asked to be read as numbers), and for all columns without
    ``moments``."""
    numeric = set(pair.numeric_columns()) | set(coerced or []) if moments else set()
    aggs, rows = {"rows": "count(1)"}, []
    for i, c in enumerate(pair.columns):
        aggs[f"nn{i}"] = f"count({quoted(c)})"
        has = c in numeric
        if has:
            v, dtype = as_number(quoted(c), pair.dtype(c)), pair.dtype(c)
            aggs |= {
                f"num{i}": f"count({v})",
                f"sum{i}": f"CAST(sum({summable(quoted(c), dtype)}) AS double)",
                f"min{i}": f"CAST(min({v}) AS double)",
                f"max{i}": f"CAST(max({v}) AS double)",
                f"avg{i}": f"avg(CAST({v} AS double))",
                f"std{i}": f"stddev_samp(CAST({v} AS double))",
            }
        pick = lambda stem, kind="double": f"{stem}{i}" if has else f"CAST(NULL AS {kind})"
        rows.append(
            struct(
                column=literal(c),
                is_numeric=str(has).lower(),
                rows="rows",
                non_null=f"nn{i}",
                nulls=f"rows - nn{i}",
                numbers=pick("num", "bigint"),
                total=f"coalesce(sum{i}, 0D)" if has else "CAST(NULL AS double)",
                min=pick("min"),
                max=pick("max"),
                mean=pick("avg"),
                stddev=pick("std"),
            )
        )
    long = unpivot(aggregate(pair.tagged(), [IS_SOURCE], aggs), [IS_SOURCE], rows)
    return long.selectExpr("*", "CASE WHEN rows > 0 THEN nulls / rows ELSE 0D END AS null_ratio")


def column_profile(
    pair: Pair, percentiles: list[float], rows_per_bin: int = 1_000_000, rows: int | None = None
) -> DataFrame:
    """Rows (is_source, column, stat, value) of every numeric column: counts, moments, percentiles."""
    stats = [struct(stat=literal(s), value=f"CAST({quoted(s)} AS double)") for s in COUNTS + MOMENTS]
    moments = unpivot(side_profile(pair).where("is_numeric"), [IS_SOURCE, quoted("column")], stats)
    return moments.unionAll(column_percentiles(pair, pair.numeric_columns(), percentiles, rows_per_bin, rows))


def stat_names(percentiles: list[float]) -> list[str]:
    return MOMENTS + [percentile_name(p) for p in percentiles]


def profile_deviation(profile: DataFrame, tolerance: float) -> DataFrame:
    """(column, stat, source_value, target_value, relative_diff, deviates) from the rows of
    ``column_profile``. A stat that is null on either side is not an issue."""
    compared = profile.where(f"stat NOT IN ({', '.join(map(literal, COUNTS))})")
    both = both_sides(compared, ["column", "stat"], {"value": "value"})
    diff = relative_diff("source_value", "target_value")
    return both.selectExpr("*", f"{diff} AS relative_diff").selectExpr(
        "*", f"coalesce(relative_diff > {float(tolerance)!r}D, false) AS deviates"
    )


def distribution_confidence(deviation: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row (n_stats, n_ok, score, passed): the share of stats that do not deviate."""
    counted = deviation.selectExpr("count(1) AS n_stats", "count_if(NOT deviates) AS n_ok")
    scored = counted.selectExpr("*", "CASE WHEN n_stats > 0 THEN n_ok / n_stats ELSE 1D END AS score")
    return scored.selectExpr("*", f"score >= {float(threshold)!r}D AS passed")


def null_ratios(profile: DataFrame, tolerance: float) -> DataFrame:
    """(column, source_nulls, target_nulls, source_null_ratio, target_null_ratio, delta,
    deviates) from the rows of ``side_profile``."""
    both = both_sides(profile, ["column"], {"nulls": "nulls", "null_ratio": "null_ratio"}, default="0")
    return both.selectExpr("*", "abs(source_null_ratio - target_null_ratio) AS delta").selectExpr(
        "*", f"delta > {float(tolerance)!r}D AS deviates"
    )
