"""Column profiles that are kept: sketches per partition of a table, merged on read.

A partition is profiled once: counts, ends, a KLL sketch for quantiles and a theta sketch for distinct values, a few kilobytes a column.
Merging the sketches of all partitions gives the figures of the table, so a second look at a table that has grown scans the new
partitions only. Theta sketches of two tables also intersect, which tells how many values of a column both hold, without
bringing the tables together.

Counts, nulls and ends are exact. A quantile is a value whose rank is off by at most about 1.7 / ``KLL`` of the rows, and a number of
distinct values is exact up to 2^``LG_THETA`` and off by about 1 / sqrt(2^``LG_THETA``) beyond (one standard error). A
partition that was changed after it was profiled has to be forgotten (``forget``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.sql import aggregate, literal, quoted, struct, unpivot
from concordat.functions.types import is_numeric
from concordat.session import materialise
from concordat.sources.paths import exists

KLL, LG_THETA = 1024, 14
PARTITION = "partition"
STORED = f"{PARTITION} string, column string, numeric boolean, rows bigint, non_null bigint, low double, high double, kll binary, theta binary"


def partition_profile(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """The rows of ``STORED`` for every value of the partition column: one scan, of which sketches are shuffled."""
    aggs, cells = {"rows": "count(1)"}, []
    for i, c in enumerate(columns):
        numeric, name = is_numeric(df.schema[c].dataType), quoted(c)
        aggs |= {f"n{i}": f"count({name})", f"t{i}": f"theta_sketch_agg(CAST({name} AS string), {LG_THETA})"}
        ends = ("CAST(NULL AS double)",) * 2 + ("CAST(NULL AS binary)",)
        if numeric:
            number = f"CAST({name} AS double)"
            aggs |= {f"l{i}": f"min({number})", f"h{i}": f"max({number})", f"k{i}": f"kll_sketch_agg_double({number}, {KLL})"}
            ends = (f"l{i}", f"h{i}", f"CASE WHEN n{i} > 0 THEN k{i} END")
        cells.append(struct(column=literal(c), numeric=str(numeric).lower(), rows="rows", non_null=f"n{i}", low=ends[0], high=ends[1], kll=ends[2], theta=f"t{i}"))
    keyed = df.selectExpr(f"CAST({quoted(by)} AS string) AS {PARTITION}", *map(quoted, columns))
    return unpivot(aggregate(keyed, [PARTITION], aggs), [PARTITION], cells)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What is kept at ``path``; nothing where nothing was."""
    return spark.read.schema(STORED).parquet(path) if exists(spark, path) else spark.createDataFrame([], STORED)


def update(df: DataFrame, path: str, by: str, columns: list[str]) -> list[str]:
    """Profile the partitions that are not kept yet and add them; their names.

    On a table stored by that column only those partitions are read. Names are few, one per partition.
    """
    spark, key = df.sparkSession, F.col(quoted(by)).cast("string")
    known = {r[0] for r in stored(spark, path).select(PARTITION).distinct().collect()}
    fresh = [r[0] for r in df.select(key.alias("p")).distinct().collect() if r[0] not in known]
    if fresh:
        values = [v for v in fresh if v is not None]
        wanted = key.isin(values) if values else F.lit(False)
        partition_profile(df.where(wanted | key.isNull() if None in fresh else wanted), by, columns).write.mode("append").parquet(path)
    return fresh


def forget(spark: SparkSession, path: str, partitions: list[str]) -> None:
    """Drop the profiles of partitions, so that the next ``update`` takes them anew."""
    from concordat.sinks.tables import persist_table

    kept = materialise(stored(spark, path).where(~F.coalesce(F.col(PARTITION).isin(partitions), F.lit(False))), "profiles")
    persist_table(kept, path=path)


def merged(profiles: DataFrame) -> DataFrame:
    """(column, numeric, rows, non_null, low, high, kll, theta) of a whole table."""
    return aggregate(
        profiles,
        ["column", "numeric"],
        {
            "rows": "sum(rows)", "non_null": "sum(non_null)", "low": "min(low)", "high": "max(high)",
            "kll": "kll_merge_agg_double(kll)", "theta": "theta_union_agg(theta)",
        },
    )


def profile(profiles: DataFrame, quantiles: list[float]) -> DataFrame:
    """(column, rows, non_null, low, high, distinct_values, quantiles)."""
    cuts = f"array({', '.join(f'{float(q)!r}D' for q in quantiles)})"
    return merged(profiles).selectExpr(
        "column", "rows", "non_null", "low", "high", "theta_sketch_estimate(theta) AS distinct_values",
        f"CASE WHEN numeric AND non_null > 0 THEN kll_sketch_get_quantile_double(kll, {cuts}) END AS quantiles",
    )


def shared_values(one: DataFrame, two: DataFrame) -> DataFrame:
    """(column, one_distinct, two_distinct, shared) for the columns that both tables' profiles have, as estimates."""
    a = merged(one).selectExpr("column", "theta AS ta")
    b = merged(two).selectExpr("column", "theta AS tb")
    est = "theta_sketch_estimate({})".format
    return a.join(b, "column").selectExpr("column", f"{est('ta')} AS one_distinct", f"{est('tb')} AS two_distinct", f"{est('theta_intersection(ta, tb)')} AS shared")
