"""The operators on a star schema: each query compares a table with an altered copy of it.

The copies drop, change, null and repeat rows by key arithmetic. That makes differences of
every kind at any scale; the queries themselves read both sides whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.config import BUSINESS, FAILED, PASSED, SKIPPED, STATISTICAL, STRUCTURAL
from concordat.config import Comparison, Margin, Rule, Tolerances, Totals
from concordat.functions.types import family
from concordat.operators import cardinality as distinct
from concordat.operators import digest_tree, duplicates, fingerprint, keyed_diff, normalise, order_stats, profile, stored_profile, structure, totals
from concordat.operators.pairing import IS_SOURCE, Pair, align
from concordat.plans import multi, payment_status, report, steps
from concordat.plans.validate import validate
from concordat.session import materialise, scratch_path
from concordat.sinks import tables as sinks
from concordat.sinks.reports import write_checks
from concordat.sources import csv_tables
from concordat.sources.constraints import constraint_violations
from concordat.sources.paths import list_csv
from concordat.sources.reports import read_checks
from concordat.sources.schema_files import comparison_hints, load_schemas

PRICE = T.DecimalType(18, 2)
RATE = T.DecimalType(6, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side_label():
    return F.when(F.col(IS_SOURCE), "source").otherwise("target").alias("side")


def nth(column: str, n: int):
    return F.col(column) % n == 0


# --- the tables and their altered copies ------------------------------------------------


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def changed_in_place(df: DataFrame) -> DataFrame:
    """Every 89th price is 10 higher, every 83rd status is lost; no row comes or goes."""
    return df.withColumns(
        {
            "o_totalprice": F.when(nth("o_orderkey", 89), F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice")),
            "o_orderstatus": F.when(~nth("o_orderkey", 83), F.col("o_orderstatus")),
        }
    )


def changed_orders(df: DataFrame) -> DataFrame:
    return changed_in_place(df).where(~nth("o_orderkey", 97))


def noisy_orders(df: DataFrame) -> DataFrame:
    noisy = F.col("o_totalprice") * (1 + 1e-7)
    return df.withColumn("o_totalprice", F.when(nth("o_orderkey", 7), noisy).otherwise(F.col("o_totalprice")))


def priced(df: DataFrame) -> DataFrame:
    return df.withColumn("o_totalprice", F.col("o_totalprice").cast(PRICE))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def exact_sums(df: DataFrame) -> DataFrame:
    """Amounts as decimals, for totals that have to be the same in any order of adding."""
    money = {c: F.col(c).cast(PRICE) for c in ("l_quantity", "l_extendedprice")}
    return df.withColumns(money | {"l_discount": F.col("l_discount").cast(RATE)})


def changed_lineitem(df: DataFrame) -> DataFrame:
    altered = df.withColumns(
        {
            "l_quantity": F.when(nth("l_partkey", 89), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")),
            "l_returnflag": F.when(~nth("l_suppkey", 83), F.col("l_returnflag")),
        }
    ).where(~nth("l_orderkey", 97))
    return altered.unionAll(altered.where(nth("l_orderkey", 101)))


def orders_pair(spark: SparkSession, sf_dir: str) -> Pair:
    o = orders(spark, sf_dir)
    return align(o, changed_orders(o))


def lineitem_pair(spark: SparkSession, sf_dir: str) -> Pair:
    li = lineitem(spark, sf_dir)
    return align(li, changed_lineitem(li))


def exact_lineitem_pair(spark: SparkSession, sf_dir: str) -> Pair:
    li = lineitem(spark, sf_dir)
    return align(exact_sums(li), exact_sums(changed_lineitem(li)))


# --- transformation ---------------------------------------------------------------------

# Tax by order priority; two priorities are left without a rate.
TAX_ROWS = "('1-URGENT', 0.10), ('2-HIGH', 0.20), ('3-MEDIUM', 0.05)"


def payment_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    invoices = o.select(
        F.col("o_orderkey").alias("belnr"),
        F.col("o_custkey").alias("sap_vendor_id"),
        F.when(F.col("o_orderstatus") == "F", "PAID").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("BLOCKED").alias(
            "payment_status_raw"
        ),
        F.lit("EUR").alias("waers"),
        F.col("o_totalprice").cast(PRICE).alias("wrbtr"),
        F.col("o_orderpriority").alias("mwskz"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("bldat"),
        F.date_format(F.date_add("o_orderdate", 30), "yyyyMMdd").alias("zfbdt"),
        F.lit("T").alias("zlsch"),
    )
    vendors = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(
        F.col("c_custkey").alias("sap_vendor_id"),
        F.col("c_name").alias("vendor_name"),
        F.col("n_name").alias("country_code"),
        F.col("c_mktsegment").alias("payment_terms"),
    )
    rates = spark.sql(f"SELECT code AS tax_code, CAST(rate AS DECIMAL(6,4)) AS tax_rate FROM VALUES {TAX_ROWS} AS t(code, rate)")
    return invoices, vendors, rates


def _as_doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def payment_status_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_doubles(
        payment_status.payment_status(*payment_inputs(spark, sf_dir)), "gross_amount", "tax_rate", "net_amount"
    )


def payment_status_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same job without its limit, over every order."""
    out = payment_status.payment_status(*payment_inputs(spark, sf_dir), limit=None)
    return _as_doubles(out, "gross_amount", "tax_rate", "net_amount")


def steps_ctas_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal rows, a joined step, a step used twice, a stored table, a final select."""
    for name in ("orders", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"in_{name}")
    chain = steps.run_steps(
        spark,
        [
            ("tax", f"SELECT code, CAST(rate AS DECIMAL(6,4)) AS rate FROM VALUES {TAX_ROWS} AS t(code, rate)"),
            (
                "netted",
                "SELECT c_mktsegment AS segment, o_orderkey, "
                "round(CAST(o_totalprice AS DECIMAL(18,2)) * (1 - rate), 2) AS net "
                "FROM in_orders LEFT JOIN in_customer ON o_custkey = c_custkey LEFT JOIN tax ON o_orderpriority = code",
            ),
            ("netted", "SELECT segment, o_orderkey, coalesce(net, 0) AS net FROM netted"),
        ],
        outputs=["netted"],
    )
    stored = materialise(chain["netted"], "netted")
    stored.createOrReplaceTempView("stored_netted")
    return steps.run_query(
        spark,
        "SELECT segment, count(*) AS n_orders, CAST(sum(net) AS DOUBLE) AS net_total FROM stored_netted GROUP BY segment",
    )


# --- structure --------------------------------------------------------------------------


def structural_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lost column, a new one, one with another type, one with more nulls."""
    o = orders(spark, sf_dir)
    t = changed_orders(o).withColumn("o_custkey", F.col("o_custkey").cast("string"))
    t = t.withColumnRenamed("o_orderpriority", "o_rank")
    return structure.structural_report(o, t)


# --- data level -------------------------------------------------------------------------


def _portable(spark: SparkSession, sf_dir: str, columns: bool = True, buckets: int = 10) -> tuple[Pair, DataFrame]:
    o = priced(orders(spark, sf_dir)).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    pair = align(o, priced(changed_orders(orders(spark, sf_dir))).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")))
    return pair, fingerprint.bucket_digests(pair, ["o_orderkey"], buckets, "portable", columns)


def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, partial = _portable(spark, sf_dir, columns=False)
    return fingerprint.dataset_digest(partial).select(side_label(), "rows", "digest_sum", "digest_xor")


def column_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair, partial = _portable(spark, sf_dir)
    return fingerprint.column_digests(partial, pair.columns).select(side_label(), "column", "rows", "digest_sum", "digest_xor")


def bucket_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, partial = _portable(spark, sf_dir, columns=False)
    return fingerprint.compare_digests(fingerprint.bucket_checksums(partial), ["bucket"])


def fingerprint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns hold the same values on both sides, by the engine's own fast hashes."""
    li = lineitem(spark, sf_dir)
    altered = li.withColumn("l_quantity", F.when(nth("l_partkey", 89), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    altered = altered.withColumn("l_returnflag", F.when(~nth("l_suppkey", 83), F.col("l_returnflag")))
    pair = align(li, altered)
    digests = fingerprint.column_digests(fingerprint.bucket_digests(pair, []), pair.columns)
    return fingerprint.compare_digests(digests, ["column"]).select("column", "source_rows", "target_rows", "matches")


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_rows(lineitem_pair(spark, sf_dir))


def row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_diff.row_diff(orders_pair(spark, sf_dir), ["o_orderkey"])


def digest_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few differences in many rows: the differing keys, and how many rows had to be shuffled to find them."""
    o = priced(orders(spark, sf_dir))
    few = o.withColumn("o_totalprice", F.when(nth("o_orderkey", 4999), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast(PRICE)).where(~nth("o_orderkey", 7919))
    found = digest_tree.drill_down(align(o, few), ["o_orderkey"], fan=64, few_rows=0, kind="portable")
    rows = keyed_diff.row_diff(found.pair, ["o_orderkey"])
    return rows.withColumn("rows_shuffled", F.lit(found.levels[-1].rows).cast("long"))


def row_diff_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_diff.row_diff(lineitem_pair(spark, sf_dir), ["l_orderkey", "l_linenumber"])


def cell_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = priced(orders(spark, sf_dir))
    pair = align(o, priced(changed_orders(orders(spark, sf_dir))))
    changed = keyed_diff.row_diff(pair, ["o_orderkey"]).where(f"difference = '{keyed_diff.CHANGED}'")
    return keyed_diff.cell_diff(pair, ["o_orderkey"], changed.select("o_orderkey"))


# --- business rules ---------------------------------------------------------------------


def grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"]
    found = totals.grand_totals(exact_lineitem_pair(spark, sf_dir), columns, 1e-6, 0.02)
    return found.withColumns({c: F.round(c, 4) for c in ("source_value", "target_value")})


def rank_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise inside the tolerance, a shift outside it, lost values, infinities, integers past 2^53, decimals.

    Bins are small, so that there are many of them at every scale.
    """
    li = table(spark, sf_dir, "lineitem").withColumns(
        {
            "l_tax": F.when(nth("l_partkey", 11), float("inf")).when(nth("l_partkey", 13), float("-inf")).otherwise(F.col("l_tax")),
            "l_big": F.col("l_orderkey") + F.lit(2**53),
            "l_price": F.col("l_extendedprice").cast(PRICE),
            "l_flag": F.lit(1.0),
        }
    )
    noisy = F.col("l_extendedprice") * (1 + 1e-7)
    t = li.withColumns(
        {
            "l_extendedprice": F.when(nth("l_partkey", 7), noisy).otherwise(F.col("l_extendedprice")),
            "l_quantity": F.when(nth("l_partkey", 89), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")),
            "l_discount": F.when(~nth("l_suppkey", 83), F.col("l_discount")),
            "l_big": F.when(nth("l_partkey", 89), F.col("l_big") + 1).otherwise(F.col("l_big")),
        }
    )
    columns = ["l_extendedprice", "l_quantity", "l_discount", "l_orderkey", "l_tax", "l_big", "l_price", "l_flag"]
    pair = align(li.select(*columns), t.select(*columns))
    tolerances = {c: (1e-6, 1e-4) for c in columns} | {"l_extendedprice": (0.1, 1e-4)}
    found = order_stats.exceeds_tolerance(order_stats.rank_differences(pair, columns, rows_per_bin=4000), tolerances)
    return found.withColumns({c: F.round(c, 9) for c in ("max_absolute_diff", "max_relative_diff")})


def key_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise, and on each side keys that the other lacks, keys that repeat, and values that are null on one side."""
    o = orders(spark, sf_dir).withColumn("o_custkey", F.when(~nth("o_orderkey", 53), F.col("o_custkey")))
    t = noisy_orders(orders(spark, sf_dir)).withColumn("o_custkey", F.when(~nth("o_orderkey", 59), F.col("o_custkey")))
    t = t.where(~nth("o_orderkey", 97))
    t = t.unionAll(t.where(nth("o_orderkey", 61))).unionAll(t.where(nth("o_orderkey", 67)).withColumn("o_orderkey", F.col("o_orderkey") + 10**12))
    found = keyed_diff.key_differences(align(o, t), ["o_orderkey"], ["o_totalprice", "o_custkey"])
    found = order_stats.exceeds_tolerance(found, {"o_totalprice": (1e-6, 1e-4), "o_custkey": (1e-6, 1e-4)})
    return found.withColumns({c: F.round(c, 9) for c in ("max_absolute_diff", "max_relative_diff")})


def group_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["l_returnflag", "l_linestatus"]
    return totals.group_consistency(exact_lineitem_pair(spark, sf_dir), by, ["l_extendedprice", "l_quantity"], 1e-6)


def group_consistency_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by the thousand: one per part and flag."""
    by = ["l_partkey", "l_returnflag"]
    return totals.group_consistency(exact_lineitem_pair(spark, sf_dir), by, ["l_quantity"], 1e-6)


RULES = [
    Rule("lowest_price", "min(o_totalprice)"),
    Rule("open_orders", "count_if(o_orderstatus = 'O')", margin=0.02),
    Rule("price_spread", "max(o_totalprice) - min(o_totalprice)", margin=1e-9),
    Rule("customers", lambda df: F.count_distinct("o_custkey"), margin=0.0),
    Rule("never_null", "sum(CASE WHEN o_orderkey IS NULL THEN 1 END)"),
]


def custom_rules_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are whole statements over ``{table}``, one of which cannot run."""
    o = orders(spark, sf_dir)
    rules = [
        Rule("late_orders", "SELECT count(*) FROM {table} WHERE o_orderdate >= timestamp_ntz '1997-01-01'"),
        Rule("dearest_open", "SELECT max(o_totalprice) FROM {table} WHERE o_orderstatus = 'O'", margin=0.5),
        Rule("no_such_column", "SELECT max(nowhere) FROM {table}"),
    ]
    cfg = Comparison(run="rules", rules=rules, layers=[BUSINESS])
    dearer = F.when(nth("o_orderkey", 89), F.col("o_totalprice") * 3).otherwise(F.col("o_totalprice"))
    checks = validate(o, o.withColumn("o_totalprice", dearer), cfg).checks
    return checks.where("check_name LIKE 'rule_%'").select("check_name", "status")


def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of columns is a check of its own, on the same rows in two orders."""
    c = table(spark, sf_dir, "customer")
    turned = c.select(*reversed(c.columns))
    parts = []
    for run_id, target in (("same", c), ("turned", turned)):
        checks = validate(c, target, Comparison(run=run_id, ordered=True, layers=[STRUCTURAL])).checks
        parts.append(checks.where("check_name = 'column_order'").select("run_id", "status"))
    return reduce(DataFrame.unionAll, parts).withColumn("rows", F.lit(c.count()).cast("long"))


def typed_ingest_failfast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean file under a strict schema, every row read and typed."""
    root = scratch_path(spark, "failfast")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.col("p_retailprice").cast(PRICE).alias("price"))
    sinks.save_csv(rows, root, "part")
    ddl = [("column_name,type",), ("p_partkey,BIGINT",), ("p_name,TEXT",), ("p_size,INT",), ('price,"DECIMAL(18,2)"',)]
    spark.createDataFrame(ddl, "line string").coalesce(1).write.text(f"{root}/ddl/part.csv")
    loaded = csv_tables.load_declared(spark, root, load_schemas(spark, f"{root}/ddl"))["part"].rows
    return loaded.withColumn("price", F.col("price").cast("double"))


def preview_and_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a table with the count of what it leaves out, kept as a fixture and read back."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    root = scratch_path(spark, "fixture")
    shown = sinks.preview(p.orderBy("p_partkey"), 10)
    path = sinks.write_fixture(spark, [r.asDict() for r in shown.head], root, "preview", "part", "head")
    back = csv_tables.read_text_columns(spark, path)
    return back.withColumns({"n_rows": F.lit(shown.rows).cast("long"), "n_more": F.lit(shown.more).cast("long")})


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    found = totals.custom_rules(o, changed_orders(o), RULES)
    return found.withColumns({c: F.round(c, 4) for c in ("source_value", "target_value")})


# --- statistics -------------------------------------------------------------------------

PERCENTILES = [0.50, 0.95, 0.99]


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(lineitem_pair(spark, sf_dir), PERCENTILES)


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).select(side_label(), "column", "stat", F.round("value", 4).alias("value"))


def profile_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.profile_deviation(_profile(spark, sf_dir), 0.01)
    rounded = {c: F.round(c, 4) for c in ("source_value", "target_value", "relative_diff")}
    return found.withColumns(rounded)


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    deviation = profile.profile_deviation(_profile(spark, sf_dir), 0.0005)
    return profile.distribution_confidence(deviation).withColumn("score", F.round("score", 6))


def incremental_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders profiled up to 1996, then the rest alone; the merged sketches against exact figures, to within their stated error.

    ``shared`` says whether the values that a second table has in common come out as they are.
    """
    path = f"{scratch_path(spark, 'profiles')}/orders"
    o = orders(spark, sf_dir).withColumn("year", F.year("o_orderdate"))
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
    stored_profile.update(o.where("year < 1996"), path, "year", columns)
    fresh = stored_profile.update(o, path, "year", columns)
    kept = stored_profile.stored(spark, path)
    half = stored_profile.partition_profile(o.where(nth("o_orderkey", 2)), "year", columns)
    found = {r["column"]: r for r in stored_profile.profile(kept, [0.5]).collect()}
    both = {r["column"]: r["shared"] for r in stored_profile.shared_values(kept, half).collect()}
    parts = []
    for c in columns:
        r, common = found[c], F.count_distinct(F.when(nth("o_orderkey", 2), F.col(c)))
        near = lambda estimate, exact: F.abs(F.lit(float(estimate)) - exact) <= 0.04 * exact + 0.5
        median = F.lit(True) if r["quantiles"] is None else F.abs(F.avg((F.col(c) <= r["quantiles"][0]).cast("double")) - 0.5) < 0.01
        parts.append(o.agg(
            F.lit(c).alias("column"), F.lit(r["rows"]).alias("rows"), F.lit(r["non_null"]).alias("non_null"), near(r["distinct_values"], F.count_distinct(c)).alias("distinct_near"),
            median.alias("median_near"), near(both[c], common).alias("shared_near"), F.lit(len(fresh)).cast("long").alias("partitions_scanned"),
        ))
    return reduce(DataFrame.unionAll, parts)


def percentiles_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles the way a table too large for the built-in aggregate takes: by value bins."""
    pair = lineitem_pair(spark, sf_dir)
    found = order_stats.column_percentiles(pair, ["l_extendedprice", "l_quantity", "l_orderkey"], PERCENTILES, rows_per_bin=5000)
    return found.select(side_label(), "column", "stat", F.round("value", 4).alias("value"))


def null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.null_ratios(profile.side_profile(lineitem_pair(spark, sf_dir), moments=False), 0.01)
    return found.withColumns({c: F.round(c, 6) for c in ("source_null_ratio", "target_null_ratio", "delta")})


def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.cardinality(lineitem_pair(spark, sf_dir), 0.01)


# --- report and many comparisons --------------------------------------------------------


def _check_rows(df: DataFrame, run_id: str, comparison: str, layer: str, name, failed, skipped=None) -> DataFrame:
    status = F.when(failed, FAILED).otherwise(PASSED)
    status = F.when(skipped, SKIPPED).otherwise(status) if skipped is not None else status
    return df.select(
        F.lit(run_id).alias("run_id"),
        F.lit(comparison).alias("comparison"),
        F.lit(layer).alias("layer"),
        name.alias("check_name"),
        status.alias("status"),
        F.lit("").alias("message"),
        F.lit("{}").alias("details"),
        F.lit(0.0).alias("duration_ms"),
        F.lit("").alias("skipped_reason"),
    )


def _column_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One check row per column and kind of check, over two comparisons."""
    o = orders(spark, sf_dir)
    frames = []
    for comparison, t in (("altered", changed_orders(o)), ("same", o)):
        pair = align(o, t)
        # Read twice below, a few rows: one profile of the pair serves both.
        nulls = materialise(profile.null_ratios(profile.side_profile(pair, moments=False), 0.01), "nulls")
        same = F.col("source_nulls") == F.col("target_nulls")
        frames += [
            _check_rows(nulls, "r1", comparison, STRUCTURAL, F.concat(F.lit("nulls_"), "column"), ~same),
            _check_rows(nulls, "r1", comparison, STATISTICAL, F.concat(F.lit("null_ratio_"), "column"), F.col("deviates")),
            _check_rows(
                distinct.cardinality(pair, 0.01),
                "r1",
                comparison,
                STATISTICAL,
                F.concat(F.lit("cardinality_"), "column"),
                F.col("deviates"),
            ),
            _check_rows(
                totals.grand_totals(pair, ["o_totalprice"], 1e-6, 1e-4),
                "r1",
                comparison,
                BUSINESS,
                F.concat(F.lit("total_"), F.lower("function")),
                ~F.col("agrees"),
                # An average is left out, as a check nobody asked for.
                F.col("function") == "AVG",
            ),
        ]
    return reduce(DataFrame.unionAll, frames)


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.summarise(_column_checks(spark, sf_dir))
    layers = F.concat_ws(",", F.transform(F.map_entries("layer_statuses"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    failures = F.concat_ws(",", F.transform("failures", lambda f: F.concat_ws("/", f["layer"], f["check_name"])))
    return out.select(
        "run_id",
        "comparison",
        "total_checks",
        "passed",
        "failed",
        "skipped",
        "pass_rate",
        "equivalent",
        failures.alias("failures"),
        layers.alias("layer_statuses"),
    )


def two_phase_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outputs against three baselines: one off in both, one equal, one off in one."""
    o, c = orders(spark, sf_dir), table(spark, sf_dir, "customer")
    baselines = {
        "simulated": {"orders": changed_orders(o), "customer": c},
        "recorded": {"orders": o.repartition("o_orderkey"), "customer": c},
        "partial": {"orders": o, "customer": c.where(~nth("c_custkey", 97))},
        "without_customer": {"orders": o},
    }
    verdict = multi.validate_two_phases(spark, {"orders": o, "customer": c}, baselines)
    checks = reduce(DataFrame.unionAll, [r.checks for r in verdict.reports.values()])
    # The same verdict from the check rows alone, as a reader of saved reports takes it.
    return multi.two_phase_verdict(multi.phases_from_checks(checks, list(baselines), ["orders", "customer"]))


def compare_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(comparison, status): an equal pair, a changed one, a table without output, one nobody expected."""
    o, c, p = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    outputs = {"equal": o, "changed": c.withColumn("c_acctbal", F.col("c_acctbal") + nth("c_custkey", 89).cast("int")), "surplus": p}
    expected = {"equal": o.repartition("o_custkey"), "changed": c, "absent": p}
    found = multi.compare_many(spark, multi.pair_up(outputs, expected), Comparison(run="many"))
    return report.overall_status(found.checks).select("comparison", "status")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts of a test set over all orders, two of them with gaps."""
    o, c, p = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    parts = {
        "input": {"orders": o, "customer": c, "part": p},
        "expected": {"orders": o.where("o_totalprice < 0"), "customer": c},
        "model": {"orders": o, "customer": c.where("c_acctbal > 1e12"), "part": p.where("p_size < 0")},
    }
    return multi.completeness(["orders", "customer", "part"], parts, spark)


def full_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four layers in one call: (layer, check_name, status) of every check."""
    o = orders(spark, sf_dir)
    cfg = Comparison(
        run="full",
        key=["o_orderkey"],
        totals=Totals(["o_totalprice"], ["o_orderpriority"]),
        tolerances=Tolerances({"o_totalprice": Margin(0.5, 1e-3)}),
        rules=[Rule("customers", "count(DISTINCT o_custkey)")],
    )
    return validate(o, noisy_orders(o), cfg).checks.select("layer", "check_name", "status")


# --- normalisation ----------------------------------------------------------------------


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an export might spell them: null tokens, stray blanks, tabs."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias(" Cust-Key "),
        F.when(key % 11 == 0, " N/A ").when(key % 13 == 0, "Null").when(key % 17 == 0, "").otherwise(F.col("c_mktsegment")).alias("Mkt Segment"),
        F.concat(F.lit(" \t"), F.col("c_name"), F.lit("  \n")).alias("Nom complèt"),
        F.when(key % 7 == 0, F.lit(" ?")).otherwise(F.col("c_acctbal").cast(PRICE).cast("string")).alias("Acct-Bal"),
    )


def normalise_nulls_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.unify_nulls_and_trim(normalise.normalise_columns(dirty_customer(spark, sf_dir)))


def textual_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with everything as text: dates in two spellings, prices with gaps, years."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("K"), key).alias("o_orderkey"),
        F.when(key % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(key % 10 != 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise("soon")
        .alias("placed"),
        F.when(key % 4 == 0, "n.c.").otherwise(F.col("o_totalprice").cast(PRICE).cast("string")).alias("price"),
        F.date_format("o_orderdate", "yyyy").alias("season"),
        F.when(key % 3 == 0, F.col("o_custkey").cast("string")).otherwise(F.concat(F.lit("C"), "o_custkey")).alias("buyer"),
        F.col("o_orderpriority").alias("update_mark"),
    )


def type_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = normalise.type_decisions(normalise.type_evidence(textual_orders(spark, sf_dir)))
    return decided.select("column", "filled", "years", "dates", "numbers", "becomes")


def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalise.infer_types(textual_orders(spark, sf_dir)).rows
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("placed", "update_mark")})


def date_format_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written day first, month first, both ways, and such that either reading fits; each column is read in one order."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    low = F.make_date(F.year(day), F.month(day), F.day(day) % 12 + 1)
    texts = table(spark, sf_dir, "orders").select(
        F.date_format(day, "dd/MM/yyyy").alias("day_first"),
        F.date_format(day, "MM/dd/yyyy").alias("month_first"),
        F.date_format(low, "MM/dd/yyyy").alias("either"),
        F.when(key % 10 == 0, F.date_format(day, "MM/dd/yyyy")).when(key % 3 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "d.M.yyyy")).alias("mixed_day"),
    )
    found = normalise.infer_types(texts)
    parts = []
    for c in texts.columns:
        days = F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
        read = found.rows.agg(F.count(c).alias("n_read"), F.sum(days).alias("days"))
        parts.append(read.select(F.lit(c).alias("column"), F.lit(found.orders[c][0]).alias("date_order"), F.lit(found.ambiguous.get(c, 0)).cast("long").alias("n_ambiguous"), "n_read", "days"))
    return reduce(DataFrame.unionAll, parts)


def normalise_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on two sides: names that repeat, null tokens, dates, numbers, and a column left as text.

    ``notice`` reads as a number for nine values in ten, but conversion would lose the others on one side.
    """
    key = F.col("o_orderkey")

    def export(shift: int) -> DataFrame:
        return table(spark, sf_dir, "orders").select(
            key.cast("string").alias(" Order-Key "),
            F.when(key % 11 == 0, " N/A ").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("Placed"),
            F.when(key % 13 == 0, "?").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast(PRICE).cast("string"))).alias("Prix"),
            F.date_format("o_orderdate", "yyyy").alias("Prix"),
            F.when(key % 10 == shift, "see note").otherwise(F.col("o_custkey").cast("string")).alias("Notice"),
        )

    both = normalise.normalise_pair(export(3), export(-1))
    shown = both.source.withColumn("placed", F.date_format("placed", "yyyy-MM-dd")).withColumn("notice", F.col("notice").cast("string"))
    return shown.withColumn("order_key", F.col("order_key").cast("double"))


# --- ingest and sinks -------------------------------------------------------------------


def _schema_file(spark: SparkSession, path: str, lines: list[tuple]) -> None:
    names = "column_name string, type string, nullable string, primary_key string"
    sinks.write_csv(spark.createDataFrame(lines, names).coalesce(1), path)


def _written_customer(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Customers as a CSV with bad cells under padded headers, and the schema it should fit."""
    root = scratch_path(spark, "ingest")
    key = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias(" C_NAME "),
        key.alias("C_CustKey"),
        F.when(key % 19 == 0, "12,5").when(key % 23 == 0, "").otherwise(F.col("c_acctbal").cast(PRICE).cast("string")).alias("c_acctbal"),
        F.when(key % 29 == 0, "1d").otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"),
        F.when(key % 31 == 0, "31/02/2024").otherwise(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_nationkey")), "dd/MM/yyyy")).alias("since"),
    )
    sinks.write_csv(raw, f"{root}/data/customer.csv")
    _schema_file(
        spark,
        f"{root}/ddl/customer.csv",
        [
            ("c_custkey", "BIGINT", "false", "true"),
            ("c_name", "VARCHAR(255)", "false", "false"),
            ("c_nationkey", "Integer", "true", "no"),
            ("c_acctbal", "DECIMAL(18,2)", "yes", "0"),
            ("since", "DATE", "1", ""),
        ],
    )
    return f"{root}/data", f"{root}/ddl"


def _quarantined(spark: SparkSession, sf_dir: str) -> csv_tables.TypedLoad:
    data, ddl = _written_customer(spark, sf_dir)
    return csv_tables.load_declared(spark, data, load_schemas(spark, ddl), mode="quarantine")["customer"]


def typed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quarantined(spark, sf_dir).rows
    return _as_doubles(rows, "c_acctbal").withColumn("since", F.date_format("since", "yyyy-MM-dd"))


def typed_ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = _quarantined(spark, sf_dir).rejects
    return rejects.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_acctbal", "c_nationkey", "since", F.concat_ws(",", "bad_columns").alias("bad_columns")
    )


def _ragged_customer(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Customers as raw lines: every 7th has a cell too many, every 11th one too few, every 13th a separator inside quotes."""
    root, key = scratch_path(spark, "ragged"), F.col("c_custkey")
    name = F.when(key % 13 == 0, F.concat(F.lit('"the ""first"", '), "c_name", F.lit('"'))).otherwise(F.col("c_name"))
    line = F.concat_ws(",", key.cast("string"), name, F.when(key % 11 != 0, F.col("c_nationkey").cast("string")), F.when(key % 7 == 0, "LOST"))
    header = "c_custkey,c_name,c_nationkey"
    raw = table(spark, sf_dir, "customer").select(line.alias(header))
    raw.write.option("header", True).option("sep", "\x01").option("quote", "").csv(f"{root}/data/customer.csv")
    _schema_file(spark, f"{root}/ddl/customer.csv", [("c_custkey", "BIGINT", "", ""), ("c_name", "TEXT", "", ""), ("c_nationkey", "INT", "", "")])
    return f"{root}/data", f"{root}/ddl"


def ragged_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are wider or narrower than their header, whole and with the reason; the others are rows."""
    data, ddl = _ragged_customer(spark, sf_dir)
    load = csv_tables.load_declared(spark, data, load_schemas(spark, ddl), mode="quarantine")["customer"]
    kept = load.rows.select(F.col("c_custkey").cast("string").alias("record"), F.lit("row").alias("reason"), F.col("c_name").alias("c_name"))
    return load.rejects.select("record", "reason", F.lit(None).cast("string").alias("c_name")).unionAll(kept)


def multiline_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with line breaks, quotes and blank lines inside, read by as many tasks as the files have splits."""
    root, key = scratch_path(spark, "multiline"), F.col("o_orderkey")
    note = F.when(key % 3 == 0, F.concat(F.lit("first\n\nof "), "o_orderpriority", F.lit('\r\n"second", third'))).otherwise(F.col("o_orderpriority"))
    rows = orders(spark, sf_dir).select("o_orderkey", note.alias("note"), "o_orderstatus")
    sinks.write_csv(rows, f"{root}/orders.csv")
    return csv_tables.read_text_columns(spark, f"{root}/orders.csv", multiline=True)


def schema_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a schema file tells a comparison, put to use: rows that differ under its key, with the family of each column."""
    root = scratch_path(spark, "hints")
    declared = [("o_orderkey", "BIGINT", "false", "true"), ("o_custkey", "BIGINT", "", ""), ("o_orderstatus", "CHAR(1)", "", ""), ("o_totalprice", "DOUBLE", "", "")]
    _schema_file(spark, f"{root}/orders.csv", declared)
    hints = comparison_hints(load_schemas(spark, root)["orders"])
    o = orders(spark, sf_dir).select(*hints["column_types"])
    changed = keyed_diff.row_diff(align(o, changed_orders(o)), hints["primary_key"])
    families = ",".join(f"{c}={kind}" for c, kind in hints["column_types"].items())
    return changed.groupBy("difference").agg(F.count(F.lit(1)).alias("n_keys")).withColumn("families", F.lit(families))


def failure_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons that cannot be carried out: a file that does not exist, one with surplus cells, a row that breaks a layer, a rule of two rows."""
    data, _ = _ragged_customer(spark, sf_dir)
    o = orders(spark, sf_dir)
    breaks = F.when(F.col("o_orderkey") % 1000 == 999, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("o_orderpriority"))
    missing, ragged = f"{scratch_path(spark, 'nowhere')}/a.csv", f"{data}/customer.csv"
    cases = {
        "missing": validate(missing, missing, Comparison(run="isolated"), spark),
        "ragged": validate(ragged, ragged, Comparison(run="isolated"), spark),
        "broken": validate(o, o.withColumn("o_orderpriority", breaks), Comparison(run="isolated")),
        "rule": validate(o, o, Comparison(run="isolated", rules=[Rule("rows", "SELECT o_orderstatus FROM {table}")], layers=[BUSINESS])),
    }
    rows = [(case, r.overall_status, ",".join(sorted(c.name for c in r.check_rows if c.status == FAILED))) for case, r in cases.items()]
    return spark.createDataFrame(rows, "case string, status string, failed string")


def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared key that is not unique and a required column with gaps."""
    declared = T.StructType(
        [
            T.StructField("l_orderkey", T.LongType(), True, {"primary_key": True, "nullable": False}),
            T.StructField("l_linenumber", T.IntegerType(), True, {"primary_key": True, "nullable": False}),
            T.StructField("l_returnflag", T.StringType(), True, {"nullable": False}),
        ]
    )
    li = table(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.when(~nth("l_suppkey", 83), F.col("l_returnflag")))
    return constraint_violations(li.select(*declared.names), declared)


def inferred_ingest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text and type-inferring loads of the same files, profiled column by column."""
    root = scratch_path(spark, "inferred")
    p = table(spark, sf_dir, "part")
    sinks.write_csv(p.select("p_partkey", "p_name", "p_size", F.col("p_retailprice").cast(PRICE).alias("P_RetailPrice ")), f"{root}/part.csv")
    sinks.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), f"{root}/supplier.csv")
    text, typed = csv_tables.load_all_text(spark, root), csv_tables.load_inferred(spark, root)
    out = []
    for name in text:
        side = profile.side_profile(align(text[name], text[name].limit(0))).where(F.col(IS_SOURCE))
        kinds = [(f.name, family(f.dataType)) for f in typed[name].schema.fields]
        kinds = spark.createDataFrame(kinds, "column string, inferred_family string")
        distinct_values = distinct.cardinality(align(text[name], text[name].limit(0)))
        out.append(
            side.join(kinds, "column")
            .join(distinct_values, "column")
            .select(F.lit(name).alias("table_name"), "column", "rows", "non_null", "inferred_family", F.col("source_cardinality").alias("distinct_values"))
        )
    return reduce(DataFrame.unionAll, out)


def delimiter_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "delimiters")
    paths = {}
    for label, sep in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("pipe", "|")):
        paths[label] = f"{root}/{label}"
        rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
        rows.write.option("header", False).option("sep", sep).csv(paths[label])
    return csv_tables.delimiter_profile(spark, paths)


def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs saved as CSV, as an extra CSV copy and as a table, each read back whole."""
    root = scratch_path(spark, "sinks")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast(PRICE).alias("c_acctbal"), F.when(~nth("c_custkey", 9), F.col("c_mktsegment")).alias("c_mktsegment"))
    sinks.save_outputs({"customer": c}, root, {"customer": f"{root}/copies/customer_again.csv"})
    back = {
        "csv": csv_tables.read_text_columns(spark, f"{root}/customer.csv"),
        "extra_csv": csv_tables.read_text_columns(spark, f"{root}/copies/customer_again.csv"),
        "table": spark.read.parquet(f"{root}/customer.parquet"),
    }
    frames = [
        df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.coalesce("c_mktsegment", F.lit("")) == "").alias("n_blank"),
            F.sum(F.col("c_acctbal").cast(PRICE)).cast("double").alias("balance"),
        ).select(F.lit(copy).alias("copy"), "n_rows", "n_blank", "balance")
        for copy, df in back.items()
    ]
    return reduce(DataFrame.unionAll, frames)


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check rows written as JSON by two runs and summarised after reading them back."""
    path = scratch_path(spark, "reports")
    rows = materialise(_column_checks(spark, sf_dir), "checks")
    write_checks(rows, path)
    write_checks(rows.withColumn("run_id", F.lit("r2")), path)
    return report.overall_status(read_checks(spark, path))


def published_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs publish the same table; readers get the second, whole."""
    root = scratch_path(spark, "published")
    o = orders(spark, sf_dir)
    sinks.publish_run(spark, {"orders": changed_orders(o)}, root, "first")
    sinks.publish_run(spark, {"orders": o}, root, "second")
    back = sinks.read_published(spark, root, "orders")
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast(PRICE)).cast("double").alias("total_price")
    )


def atomic_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after an overwrite that fails half way, after one that succeeds, and after one made from the table itself."""
    path, o = f"{scratch_path(spark, 'overwrite')}/orders", orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast(PRICE).alias("price"))
    seen = lambda: materialise(spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("price").alias("total")), "seen")
    sinks.persist_table(o, path=path)
    broken = F.when(F.col("o_orderkey") % 1000 == 999, F.raise_error(F.lit("broken row")).cast(PRICE)).otherwise(F.col("price"))
    states = {}
    try:
        sinks.persist_table(o.withColumn("price", broken), path=path)
    except Exception as error:  # noqa: BLE001 - the failure is the case
        if "broken row" not in str(error):
            raise
        states["failed"] = seen()
    sinks.persist_table(o.where(~nth("o_orderkey", 97)), path=path)
    states["replaced"] = seen()
    sinks.persist_table(spark.read.parquet(path).where(~nth("o_orderkey", 89)), path=path)
    states["from_itself"] = seen()
    return reduce(DataFrame.unionAll, [df.select(F.lit(state).alias("state"), "o_orderstatus", "n_orders", F.col("total").cast("double").alias("total")) for state, df in states.items()])


def pipeline_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared inputs, two steps, saved and read back; a second, shorter run leaves none of the first one's outputs."""
    root = scratch_path(spark, "pipeline")
    ddl = {"invoices": "column_name,type\no_orderkey,BIGINT\no_custkey,BIGINT\nprice,\"DECIMAL(18,2)\"\n", "vendors": "column_name,type\nc_custkey,BIGINT\nsegment,TEXT\n"}
    for name, text in ddl.items():
        spark.createDataFrame([(line,) for line in text.splitlines()], "line string").coalesce(1).write.text(f"{root}/ddl/{name}.csv")
    rows = orders(spark, sf_dir).select("o_orderkey", "o_custkey", F.col("o_totalprice").cast(PRICE).alias("price"))
    sinks.save_csv(rows, f"{root}/data", "invoices")
    sinks.save_csv(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), f"{root}/data", "vendors")
    joined = ("joined", "SELECT segment, price FROM invoices LEFT JOIN vendors ON o_custkey = c_custkey")
    totals_ = ("totals", "SELECT segment, count(*) AS n, CAST(sum(price) AS DOUBLE) AS total FROM joined GROUP BY segment")
    for chosen in (["joined", "totals"], ["totals"]):
        steps.execute(spark, [joined, totals_], f"{root}/data", f"{root}/ddl", f"{root}/out", chosen, show=False)
    left = [name for name, _ in list_csv(spark, f"{root}/out")]
    return spark.read.parquet(f"{root}/out/totals.parquet").withColumn("outputs", F.lit(",".join(left)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        payment_status_job,
        payment_status_full,
        steps_ctas_chain,
        structural_report,
        dataset_fingerprint,
        column_fingerprints,
        bucket_checksums,
        fingerprint_match,
        duplicate_rows,
        row_diff,
        digest_drilldown,
        row_diff_repeated_keys,
        cell_diff,
        grand_totals,
        rank_tolerance,
        key_tolerance,
        group_consistency,
        group_consistency_many,
        custom_rules,
        custom_rules_by_query,
        column_order,
        typed_ingest_failfast,
        preview_and_fixture,
        column_profile,
        profile_deviation,
        confidence,
        incremental_profile,
        percentiles_by_bin,
        null_ratio,
        cardinality,
        report_summary,
        two_phase_verdict,
        compare_many,
        completeness,
        full_validation,
        normalise_nulls_trim,
        type_evidence,
        type_inference,
        date_format_election,
        normalise_chain,
        typed_ingest,
        typed_ingest_rejects,
        ragged_rejects,
        multiline_ingest,
        schema_hints,
        failure_isolation,
        constraint_report,
        inferred_ingest_profile,
        delimiter_detect,
        sink_roundtrip,
        report_roundtrip,
        published_run,
        atomic_overwrite,
        pipeline_execute,
    )
}
