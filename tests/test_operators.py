"""Operators against brute force, and the choices that differ from a plain join or sort."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concordat.functions.names import normalise_name, normalise_names, unique_names
from concordat.operators import cardinality, digest_tree, duplicates, fingerprint, keyed_diff, lookup, order_stats, profile, stored_profile, totals
from concordat.operators.pairing import IS_SOURCE, align


def pair_of(spark, source, target, schema):
    return align(spark.createDataFrame(source, schema), spark.createDataFrame(target, schema))


# --- names ------------------------------------------------------------------------------


def test_names():
    assert normalise_name("First Name ") == "first_name"
    assert normalise_name("Montant-HT") == "montant_ht"
    assert normalise_name("Größe œuvre") == "grosse_oeuvre"
    assert normalise_names(["a", "A ", "b"]) == ["a", "a_1", "b"]


@given(st.lists(st.sampled_from(["a", "a_1", "a_2", "b"]), max_size=8))
def test_unique_names_never_collide(names):
    out = unique_names(names)
    assert len(set(out)) == len(names) and all(o == n or o.startswith(n + "_") for o, n in zip(out, names))


# --- order statistics -------------------------------------------------------------------


def ranked_gap(s, t):
    s, t = sorted(x for x in s if x is not None), sorted(x for x in t if x is not None)
    if len(s) != len(t):
        return len(s), len(t), None, None
    gaps = [abs(a - b) for a, b in zip(s, t)]
    return len(s), len(t), max(gaps, default=None), max((g / (abs(a) or 1) for g, a in zip(gaps, s)), default=None)


def rank_rows(pair, columns, **how):
    return {r["column"]: tuple(r)[1:] for r in order_stats.rank_differences(pair, columns, **how).collect()}


@pytest.mark.parametrize("how", [{}, {"rows_per_bin": 40}, {"ranks_per_block": 7}, {"rows_per_bin": 25, "ranks_per_block": 3}])
def test_rank_pairing_equals_sorting(spark, how):
    rng = np.random.default_rng(1)
    n = 300
    # A third of all rows share one value; one column is heavy-tailed, one has gaps.
    hot = np.where(rng.random(n) < 0.34, 5.0, rng.integers(0, 50, n)).astype(float)
    tail = np.round(np.exp(rng.normal(0, 4, n)), 3)
    gaps = [None if rng.random() < 0.2 else float(x) for x in rng.integers(-20, 20, n)]
    source = [(float(a), float(b), c, int(i) + 2**60) for i, (a, b, c) in enumerate(zip(hot, tail, gaps))]
    target = [(float(a) + (i % 5 == 0), float(b) * 1.001, c, int(i) + 2**60 + (i == 7)) for i, (a, b, c) in enumerate(zip(hot, tail, gaps))]
    pair = pair_of(spark, source, target, "hot double, tail double, gaps double, big bigint")
    got = rank_rows(pair, ["hot", "tail", "gaps", "big"], **how)
    for j, c in enumerate(["hot", "tail", "gaps", "big"]):
        want = ranked_gap([r[j] for r in source], [r[j] for r in target])
        assert got[c][:2] == want[:2]
        assert got[c][2:] == pytest.approx(want[2:], rel=1e-12, abs=1e-15)
    # Neighbours at 2**60 are one apart as integers and equal as doubles.
    assert got["big"][2] == 1.0


def test_rank_pairing_with_unequal_counts_and_no_values(spark):
    pair = pair_of(spark, [(1.0, None), (2.0, None)], [(1.0, None), (None, None)], "a double, b double")
    assert rank_rows(pair, ["a", "b"]) == {"a": (2, 1, None, None), "b": (0, 0, None, None)}


@pytest.mark.parametrize("rows_per_bin", [1_000_000, 30, 7])
def test_percentiles_equal_numpy(spark, rows_per_bin):
    rng = np.random.default_rng(2)
    n = 257
    a, b = rng.normal(0, 1000, n), np.where(rng.random(n) < 0.4, 3, rng.integers(0, 9, n))
    pair = pair_of(spark, [(float(x), int(y)) for x, y in zip(a, b)], [(1.5, 4)], "a double, b bigint")
    ps = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    found = order_stats.column_percentiles(pair, ["a", "b"], ps, rows_per_bin).collect()
    got = {(r[IS_SOURCE], r["column"], r["stat"]): r["value"] for r in found}
    for c, values in (("a", a), ("b", b)):
        for p in ps:
            assert got[(True, c, order_stats.percentile_name(p))] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
    assert got[(False, "a", "p50")] == 1.5 and got[(False, "b", "p99")] == 4


@pytest.mark.parametrize("how", [{}, {"rows_per_bin": 20, "ranks_per_block": 11}])
def test_percentiles_out_of_the_ranking(spark, how):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 100, 101), rng.integers(0, 4, 101)
    pair = pair_of(spark, [(float(x), int(y)) for x, y in zip(a, b)], [(1.0, None), (2.0, None)], "a double, b bigint")
    numbers = {(True, "a"): 101, (True, "b"): 101, (False, "a"): 2, (False, "b"): 0}
    ps = [0.0, 0.5, 0.95, 1.0]
    found = order_stats.rank_differences(pair, ["a", "b"], percentiles=ps, numbers=numbers, **how)
    got = {r["column"]: r for r in found.collect()}
    assert got["a"]["source_percentiles"] == pytest.approx([np.quantile(a, p) for p in ps], rel=1e-12)
    assert got["b"]["source_percentiles"] == pytest.approx([np.quantile(b, p) for p in ps])
    assert got["a"]["target_percentiles"] == pytest.approx([1.0, 1.5, 1.95, 2.0])
    assert got["b"]["target_percentiles"] == [None] * 4


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40),
    st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40),
)
def test_rank_pairing_property(spark, s, t):
    rows = lambda xs: [(None if x is None else float(x),) for x in xs]
    pair = pair_of(spark, rows(s), rows(t), "v double")
    got = rank_rows(pair, ["v"], rows_per_bin=9, ranks_per_block=4)["v"]
    assert got == pytest.approx(ranked_gap([x for (x,) in rows(s)], [x for (x,) in rows(t)]))


# --- keyed differences ------------------------------------------------------------------


def test_row_diff_classifies_and_keeps_null_keys(spark):
    source = [(1, "a"), (2, "b"), (3, "c"), (None, "n"), (5, None)]
    target = [(1, "a"), (2, "x"), (4, "d"), (None, "m"), (5, None)]
    pair = pair_of(spark, source, target, "k int, v string")
    got = {r["k"]: (r["difference"], r["source_rows"], r["target_rows"]) for r in keyed_diff.row_diff(pair, ["k"]).collect()}
    assert got == {2: ("changed", 1, 1), 3: ("missing_in_target", 1, 0), 4: ("extra_in_target", 0, 1), None: ("changed", 1, 1)}
    counts = {r["difference"]: r["n_keys"] for r in keyed_diff.diff_counts(keyed_diff.row_diff(pair, ["k"])).collect()}
    assert counts == {"changed": 2, "missing_in_target": 1, "extra_in_target": 1}


def test_repeated_keys_compare_as_multisets(spark):
    source = [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "a"), (3, "b")]
    target = [(1, "b"), (1, "a"), (2, "a"), (2, "b"), (3, "a")]
    pair = pair_of(spark, source, target, "k int, v string")
    got = {r["k"]: (r["difference"], r["source_rows"], r["target_rows"]) for r in keyed_diff.row_diff(pair, ["k"]).collect()}
    assert got == {2: ("changed", 2, 2), 3: ("changed", 2, 1)}
    cells = {tuple(r) for r in keyed_diff.cell_diff(pair, ["k"], keyed_diff.row_diff(pair, ["k"]).select("k")).collect()}
    assert cells == {(2, "v", "a", "b", 1), (3, "v", "b", None, 1)}


def test_a_key_with_a_third_of_the_rows_stays_one_group(spark):
    rows = [(0 if i % 3 == 0 else i, i % 7) for i in range(3000)]
    changed = [(k, v + (i == 300)) for i, (k, v) in enumerate(rows)]
    pair = pair_of(spark, rows, changed, "k int, v int")
    (only,) = keyed_diff.row_diff(pair, ["k"]).collect()
    assert (only["k"], only["source_rows"], only["target_rows"]) == (0, 1000, 1000)


def test_cell_diff_lists_every_changed_cell(spark):
    source = [(1, "a", 1.5, None), (2, "b", 2.0, "x")]
    target = [(1, "z", 2.5, "y"), (2, "b", 2.0, "x")]
    pair = pair_of(spark, source, target, "k int, s string, d double, n string")
    found = keyed_diff.cell_diff(pair, ["k"], keyed_diff.row_diff(pair, ["k"]).select("k")).collect()
    got = {(r["column"], r["source_value"], r["target_value"]) for r in found}
    assert got == {("s", "a", "z"), ("d", "1.5", "2.5"), ("n", None, "y")}


def test_key_columns_may_be_named_like_the_output(spark):
    schema = "`column` int, value int, source_rows int, h0 int"
    pair = pair_of(spark, [(1, 2, 3, 4), (5, 6, 7, 8)], [(1, 2, 3, 9), (5, 6, 7, 8)], schema)
    key = ["column", "value"]
    diff = keyed_diff.row_diff(pair, key)
    assert diff.count() == 1 and keyed_diff.cell_diff(pair, key, diff.select(*key)).count() == 1


def test_key_differences(spark):
    pair = pair_of(spark, [(1, 1.0), (2, 2.0), (3, None)], [(2, 2.5), (1, 1.0), (3, None)], "k int, v double")
    (r,) = keyed_diff.key_differences(pair, ["k"], ["v"]).collect()
    assert tuple(r) == ("v", 2, 2, 0.5, 0.25, 0, 0, 0, 0)


@pytest.mark.parametrize(
    "target, counts",
    [
        ([(1, 1.0), (2, 2.0), (4, 999.0)], (1, 1, 0, 0)),
        ([(1, None), (2, 2.0), (3, 3.0)], (0, 0, 0, 1)),
        ([(1, 1.0), (2, 2.0), (3, 3.0), (3, 3.0)], (0, 0, 1, 0)),
        ([(1, 1.0), (2, 2.0), (3, 3.0)], (0, 0, 0, 0)),
    ],
)
def test_keys_and_values_without_a_partner_exceed(spark, target, counts):
    pair = pair_of(spark, [(1, 1.0), (2, 2.0), (3, 3.0)], target, "k int, v double")
    found = order_stats.exceeds_tolerance(keyed_diff.key_differences(pair, ["k"], ["v"]), {"v": (1e-6, 1e-4)}).first()
    assert tuple(found[c] for c in order_stats.UNPAIRED) == counts
    assert found["exceeds"] == any(counts)


@pytest.mark.parametrize("rows_per_bin", [2, 3, 1000])
def test_infinities_equal_themselves(spark, rows_per_bin):
    inf = float("inf")
    values = [(x,) for x in (-inf, -inf, 1.0, 2.0, 3.0, inf, None)]
    for target, worst in ((values, 0.0), ([(x,) for x in (-inf, -inf, 1.0, 2.0, 3.0, 4.0, None)], inf)):
        (r,) = order_stats.rank_differences(pair_of(spark, values, target, "v double"), ["v"], rows_per_bin).collect()
        assert (r["max_absolute_diff"], r["max_relative_diff"]) == (worst, worst)
    found = order_stats.column_percentiles(pair_of(spark, values, values, "v double"), ["v"], [0.0, 0.5, 1.0], rows_per_bin).collect()
    assert {(r["stat"], r["value"]) for r in found} == {("p0", -inf), ("p50", 1.5), ("p100", inf)}


def skewed_values(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    inf = float("inf")
    value = lambda: rng.choice([7.0, 7.0, rng.gauss(0, 1), rng.gauss(0, 1) * 1e9, 1 + rng.random() * 1e-9, inf, -inf, None])
    return [(value(), rng.choice([5, rng.randint(-9, 9), 2**53 + rng.randint(0, 50)])) for _ in range(n)]


@pytest.mark.parametrize("fan, rows_per_bin", [(2, 3), (4, 10), (3, 40), (0, 7)])
def test_bins_of_any_depth_give_the_same(spark, fan, rows_per_bin):
    """Clumps at all scales, one value in a quarter of the rows, integers that a double cannot tell apart."""
    a, b = skewed_values(1, 1500), skewed_values(2, 1500)
    pair = pair_of(spark, a, b, "v double, w bigint")
    sort = lambda rows: sorted(map(str, rows))
    plain = order_stats.rank_differences(pair, ["v", "w"], 10**6).collect()
    assert sort(order_stats.rank_differences(pair, ["v", "w"], rows_per_bin, fan=fan, ranks_per_block=50).collect()) == sort(plain)
    wanted = order_stats.column_percentiles(pair, ["v", "w"], [0.0, 0.1, 0.5, 0.77, 1.0], 10**6).collect()
    assert sort(order_stats.column_percentiles(pair, ["v", "w"], [0.0, 0.1, 0.5, 0.77, 1.0], rows_per_bin, fan=fan).collect()) == sort(wanted)
    for (group, long) in order_stats._binned(pair, ["v", "w"], 1500, rows_per_bin, fan or 4):
        for r in long.groupBy("c", "bin").agg({"*": "count", "v": "max", order_stats.IS_SOURCE: "max"}).collect():
            held = long.where(f"c = {r['c']} AND bin = {r['bin']}").selectExpr("CAST(v AS double) AS d").distinct().count() if r["count(1)"] > 2 * rows_per_bin else 1
            assert held == 1, (group, r)
    # Bins are in the order of their values.
    (_, long) = order_stats._binned(pair, ["v"], 1500, rows_per_bin, fan or 4)[0]
    ends = long.groupBy("bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("bin").collect()
    assert all(x["hi"] < y["lo"] for x, y in zip(ends, ends[1:])) and len(ends) > 4


def read_by(df) -> list[str]:
    return sorted({f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in df.inputFiles()})


def test_percentiles_cut_no_bin_that_holds_no_wanted_rank(spark, tmp_path):
    rng = random.Random(5)
    spark.createDataFrame([(rng.gauss(0, 1), rng.randint(0, 400)) for _ in range(4000)], "v double, w int").write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    found = order_stats.column_percentiles(align(rows, rows.where("w > 3")), ["v", "w"], [0.25, 0.5], rows_per_bin=10, fan=16)
    kept = [f for f in found.inputFiles() if "wanted-bins" in f]
    # Two ranks a side and column, in two bins of 16 at most; values that come twice are stored once.
    assert 0 < spark.read.parquet(*kept).selectExpr("sum(n)").first()[0] < 6000
    want = {(side, c): np.quantile([r[c] for r in rows.where(f"{side} OR w > 3").collect()], [0.25, 0.5]) for side in (True, False) for c in "vw"}
    got = {(r[IS_SOURCE], r["column"], r["stat"]): r["value"] for r in found.collect()}
    assert got == {(*k, p): pytest.approx(x, rel=1e-12) for k, xs in want.items() for p, x in zip(("p25", "p50"), xs)}


def test_levels_of_a_ranking_read_the_folded_values(spark, tmp_path):
    """However deep the bins, the input is read for the fold alone, and the lookups do not grow the plan with their depth."""
    spark.createDataFrame([(float(i % 500), 2**60 + i) for i in range(3000)], "v double, w bigint").repartition(3).write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    pair = align(rows, rows.withColumn("v", F.col("v") + F.expr("IF(w % 7 = 0, 0.25D, 0D)")))
    found = order_stats.rank_differences(pair, ["v", "w"], rows_per_bin=20, fan=8)
    assert read_by(found) == ["bin-bounds", "runs"]
    runs = [f for f in found.inputFiles() if "/runs-" in f]
    folded = 500 + rows.selectExpr("v + IF(w % 7 = 0, 0.25D, 0D) AS v").distinct().count() + 2 * 3000
    assert spark.read.parquet(*runs).count() == folded
    size = lambda fan: len(order_stats.rank_differences(pair, ["w"], rows_per_bin=20, fan=fan)._jdf.queryExecution().optimizedPlan().toString())
    assert size(64) < 4 * size(8)
    assert {r["column"]: (r["source_count"], r["max_absolute_diff"]) for r in found.collect()} == {"v": (3000, 0.25), "w": (3000, 0.0)}


def test_sketches_do_not_meet_in_one_task(spark):
    pair = pair_of(spark, [(float(i),) for i in range(50)], [(float(i),) for i in range(50)], "v double")
    assert order_stats.bin_bounds(pair, ["v"], 4)["v"] == sorted(set(order_stats.bin_bounds(pair, ["v"], 4)["v"]))


@pytest.mark.parametrize("kind", ["fast", "portable"])
def test_drill_down_finds_all_and_moves_little(spark, kind):
    rows = [(i, f"v{i % 50}") for i in range(3000)] + [(None, "x"), (None, "y")]
    target = [(i, v if i not in (17, 1800) else "other") for i, v in rows if i != 2500] + [(9999, "new"), (None, "z")]
    pair = pair_of(spark, rows, target, "k int, v string")
    for fan, levels in ((16, 3), (64, 2), (2, 1)):
        found = digest_tree.drill_down(pair, ["k"], fan, few_rows=0, kind=kind, levels=levels)
        got = keyed_diff.row_diff(found.pair, ["k"])
        assert got.exceptAll(keyed_diff.row_diff(pair, ["k"])).isEmpty() and {r["k"] for r in got.collect()} == {17, 1800, 2500, 9999, None}
        assert found.levels[-1].rows == found.pair.tagged().count()
    deep = digest_tree.drill_down(pair, ["k"], 64, few_rows=0, kind=kind).levels
    assert [x.nodes for x in deep] == [64, 4096] and deep[1].rows < 40 < deep[0].rows
    # Few rows, or differences everywhere, end it at the first level; equal tables leave nothing.
    assert len(digest_tree.drill_down(pair, ["k"], 64, few_rows=10**6, kind=kind).levels) == 1
    other = pair_of(spark, rows, [(k, "w") for k, _ in rows], "k int, v string")
    assert len(digest_tree.drill_down(other, ["k"], 16, few_rows=0, kind=kind).levels) == 1
    same = digest_tree.drill_down(pair_of(spark, rows, rows[::-1], "k int, v string"), ["k"], 16, kind=kind)
    assert same.levels[0].unequal == 0 and same.pair.tagged().count() == 0


def test_rows_of_heavy_keys(spark):
    """A third of the rows under one key, a third under null; every way of joining gives the same rows."""
    rows = [(7, i) for i in range(4000)] + [(None, i) for i in range(4000)] + [(100 + i, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(4)
    keys = spark.createDataFrame([(7,), (None,), *((100 + i,) for i in range(0, 4000, 3)), (5,)], "k int")
    want = Counter(r for r in rows if r[0] in (7, None) or (r[0] - 100) % 3 == 0)
    assert len(lookup.heavy_hashes(df, ["k"])) == 2
    for most in (1 << 20, 0):
        got = lookup.rows_of(df, keys, ["k"], most_bytes=most)
        assert Counter(map(tuple, got.collect())) == want and got.columns == ["k", "v"]
    assert lookup.rows_of(df, keys.limit(0), ["k"]).isEmpty()
    # What is shuffled has no heavy key: no task holds over ten times the median.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lookup.rows_of(df, keys, ["k"], most_bytes=0)
        shuffled = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in shuffled and shuffled.count("BroadcastExchange") >= 3


def test_binary_values_are_told_apart(spark):
    pair = pair_of(spark, [(1, bytearray(b"\xff"))], [(1, bytearray(b"\xfe"))], "k int, b binary")
    (cell,) = keyed_diff.cell_diff(pair, ["k"], keyed_diff.row_diff(pair, ["k"]).select("k")).collect()
    assert (cell["source_value"], cell["target_value"]) == ("FF", "FE")


def test_maps_inside_other_types_compare_by_entries(spark):
    schema = "k int, m struct<a: array<map<string,int>>>"
    pair = pair_of(spark, [(1, ([{"x": 1, "y": 2}],)), (2, ([{"x": 1}],))], [(1, ([{"y": 2, "x": 1}],)), (2, ([{"x": 2}],))], schema)
    assert [r["k"] for r in keyed_diff.row_diff(pair, ["k"]).collect()] == [2]


def test_stored_profiles(spark, tmp_path):
    rows = [(i % 5 if i % 97 else None, float(i), f"s{i % 700}", None if i % 10 == 0 else i) for i in range(20_000)]
    df, path = spark.createDataFrame(rows, "p int, x double, s string, n long"), str(tmp_path / "profiles")
    assert stored_profile.stored(spark, path).collect() == []
    assert sorted(stored_profile.update(df.where("p < 3"), path, "p", ["x", "s", "n"])) == ["0", "1", "2"]
    assert sorted(map(str, stored_profile.update(df, path, "p", ["x", "s", "n"]))) == ["3", "4", "None"]
    assert stored_profile.update(df, path, "p", ["x", "s", "n"]) == []
    found = {r["column"]: r for r in stored_profile.profile(stored_profile.stored(spark, path), [0.1, 0.5, 0.99]).collect()}
    assert [(found[c]["rows"], found[c]["non_null"], found[c]["low"], found[c]["high"]) for c in "xsn"] == [(20_000, 20_000, 0.0, 19_999.0), (20_000, 20_000, None, None), (20_000, 18_000, 1.0, 19_999.0)]
    assert found["s"]["distinct_values"] == 700 and found["s"]["quantiles"] is None
    assert found["x"]["distinct_values"] == pytest.approx(20_000, rel=0.04)
    assert found["x"]["quantiles"] == pytest.approx([2_000, 10_000, 19_800], abs=0.01 * 20_000)
    stored_profile.forget(spark, path, ["3", "4"])
    assert sorted(stored_profile.update(df, path, "p", ["x", "s", "n"])) == ["3", "4"]
    other = stored_profile.partition_profile(df.where("x % 2 = 0").withColumn("s", F.concat("s", (F.col("x") % 4).cast("int").cast("string"))), "p", ["x", "s"])
    shared = {r["column"]: r for r in stored_profile.shared_values(stored_profile.stored(spark, path), other).collect()}
    assert shared.keys() == {"x", "s"} and shared["x"]["shared"] == pytest.approx(10_000, rel=0.05) and shared["s"]["one_distinct"] == 700


# --- digests and duplicates -------------------------------------------------------------


@pytest.mark.parametrize("kind", ["fast", "portable"])
def test_digest_ignores_order_and_sees_nulls_swaps_and_repeats(spark, kind):
    schema = "a string, b string, d double"
    base = [("x", None, 1.0), ("y", "z", -0.0), ("y", "z", 2.0)]

    def same(target) -> bool:
        pair = pair_of(spark, base, target, schema)
        partial = fingerprint.bucket_digests(pair, [], 4, kind)
        lazily = fingerprint.compare_digests(
            fingerprint.dataset_digest(partial).selectExpr("*", "'all' AS t"), ["t"]
        ).first()["matches"]
        rolled = fingerprint.roll_up(partial.collect(), pair.columns)
        assert rolled["table"]["all"]["matches"] == lazily
        assert lazily == all(r["matches"] for r in fingerprint.compare_digests(fingerprint.bucket_checksums(partial), ["bucket"]).collect())
        return lazily

    assert same(base[::-1]) and same([("x", None, 1.0), ("y", "z", 0.0), ("y", "z", 2.0)])
    assert not same([(None, "x", 1.0), *base[1:]])
    assert not same([("x", "__NULL__", 1.0), *base[1:]])
    assert not same([*base[:2], base[1]])
    assert not same([base[0], base[0], *base[1:]])
    assert not same([("x", None, 1.0 + 1e-12), *base[1:]])


def test_pairs_of_duplicates_do_not_cancel(spark):
    pair = pair_of(spark, [("a",), ("a",)], [("b",), ("b",)], "v string")
    partial = fingerprint.bucket_digests(pair, [])
    assert not fingerprint.roll_up(partial.collect(), ["v"])["table"]["all"]["matches"]


def test_column_digests_name_the_changed_column(spark):
    pair = pair_of(spark, [(1, "a"), (2, "b")], [(1, "a"), (2, "c")], "k int, v string")
    digests = fingerprint.column_digests(fingerprint.bucket_digests(pair, ["k"]), pair.columns)
    assert {r["column"]: r["matches"] for r in fingerprint.compare_digests(digests, ["column"]).collect()} == {"k": True, "v": False}


@pytest.mark.parametrize("width", [2, 12])
def test_duplicates_narrow_and_wide(spark, width):
    row = lambda i: tuple([i] + [None if i % 2 else i] * (width - 1))
    schema = ", ".join(f"c{j} int" for j in range(width))
    source = [row(i) for i in (1, 1, 1, 2, 2, 3)]
    pair = pair_of(spark, source, [row(i) for i in (1, 2, 3, 3)], schema)
    assert tuple(duplicates.duplicate_rows(pair).first()) == (3, 1)


# --- totals, groups, profile ------------------------------------------------------------


def test_group_consistency_sees_swapped_and_null_groups(spark):
    schema = "g string, v double"
    pair = pair_of(spark, [("a", 1.0), (None, 2.0), ("c", 3.0)], [("b", 1.0), (None, 2.5), ("c", 3.0)], schema)
    got = {r["g"]: r["agrees"] for r in totals.group_consistency(pair, ["g"], ["v"], 1e-6).collect()}
    assert got == {"a": False, "b": False, None: False, "c": True}


def test_group_sums_of_doubles_ignore_the_order_of_adding(spark):
    rng = np.random.default_rng(3)
    values = (rng.random(20_000) * 1e6).tolist()
    source = spark.createDataFrame([(1, v) for v in values], "g int, v double").repartition(7)
    target = spark.createDataFrame([(1, v) for v in sorted(values)], "g int, v double").repartition(3)
    assert totals.group_consistency(align(source, target), ["g"], ["v"], 1e-9).first()["agrees"]


def test_integer_totals_beyond_bigint(spark):
    big = 2**63 - 1
    pair = pair_of(spark, [(1, big)] * 3, [(1, big)] * 3, "g int, v bigint")
    assert all(r["agrees"] for r in totals.grand_totals(pair, ["v"], 0, 0).collect())
    assert totals.group_consistency(pair, ["g"], ["v"], 0).first()["source_sum"] == pytest.approx(3.0 * big)


def test_text_totals_read_numbers(spark):
    pair = pair_of(spark, [("1",), ("x",), (" 2.5 ",), ("1d",)], [("3.5",), ("x",), (None,), ("",)], "v string")
    got = {r["function"]: (r["source_value"], r["target_value"], r["agrees"]) for r in totals.grand_totals(pair, ["v"], 1e-6, 1e-4).collect()}
    assert got == {"SUM": (3.5, 3.5, True), "COUNT": (2.0, 1.0, False), "AVG": (1.75, 3.5, False)}


def test_profile_counts_nan_as_null_and_one_row_has_no_deviation(spark):
    pair = pair_of(spark, [(float("nan"), 1)], [(None, 1)], "d double, i int")
    rows = {(r[IS_SOURCE], r["column"]): r for r in profile.side_profile(pair).collect()}
    assert rows[(True, "d")]["nulls"] == 1 and rows[(True, "d")]["mean"] is None
    assert rows[(True, "i")]["stddev"] is None
    deviation = profile.profile_deviation(profile.column_profile(pair, [0.5]), 0.01)
    assert deviation.where("deviates").count() == 0
    assert profile.distribution_confidence(deviation).first()["score"] == 1.0


def test_percentile_names():
    assert profile.stat_names([0.5, 0.95]) == ["min", "max", "mean", "stddev", "p50", "p95"]


def test_cardinality_exact_and_sketched(spark):
    frame = pd.DataFrame({"k": range(2000), "few": [i % 3 for i in range(2000)], "none": [None] * 2000, "t": [f"v{i % 50}" for i in range(2000)]})
    schema = "k bigint, few int, none string, t string"
    pair = align(spark.createDataFrame(frame, schema), spark.createDataFrame(frame.head(1900), schema))
    exact = {r["column"]: tuple(r)[1:] for r in cardinality.cardinality(pair, 0.01).collect()}
    assert exact == {"few": (3, 3, 0, False), "k": (2000, 1900, 100, True), "none": (0, 0, 0, False), "t": (50, 50, 0, False)}
    for r in cardinality.cardinality(pair, 0.1, rsd=0.02).collect():
        assert math.isclose(r["source_cardinality"], exact[r["column"]][0], rel_tol=0.08)


def test_odd_column_names(spark):
    schema = "`a.b` int, `c d` double, `e``f` string, `it's` string"
    rows = [(1, 1.0, "x", "p"), (2, 2.0, "y", "q")]
    pair = pair_of(spark, rows, rows, schema)
    assert profile.side_profile(pair).count() == 8
    assert cardinality.cardinality(pair).where("source_cardinality = 2").count() == 4
    assert keyed_diff.row_diff(pair, ["a.b"]).count() == 0
    assert order_stats.rank_differences(pair, pair.numeric_columns()).where("max_absolute_diff = 0").count() == 2
    assert totals.group_consistency(pair, ["it's"], ["c d"], 0).where("agrees").count() == 2


def test_nested_columns_compare(spark):
    schema = "k int, arr array<int>, m map<string,int>, s struct<x:int>"
    rows = [(1, [1, 2], {"a": 1}, (1,)), (2, None, None, None)]
    other = [(1, [1, 3], {"a": 1}, (1,)), (2, None, None, None)]
    pair = pair_of(spark, rows, other, schema)
    digests = fingerprint.column_digests(fingerprint.bucket_digests(pair, ["k"]), pair.columns)
    unlike = {r["column"] for r in fingerprint.compare_digests(digests, ["column"]).collect() if not r["matches"]}
    assert unlike == {"arr"}
    assert {r["column"]: r["source_cardinality"] for r in cardinality.cardinality(pair).collect()}["arr"] == 1
    assert keyed_diff.cell_diff(pair, ["k"], keyed_diff.row_diff(pair, ["k"]).select("k")).count() == 1
