"""The seven comparison scenarios and the statuses each must end with."""

from __future__ import annotations

import json

import pytest

from concordat import Comparison, Margin, Rule, Statistics, Tolerances, Totals, validate
from concordat.plans import report as reports
from concordat.sinks.reports import write_checks
from concordat.sources.reports import read_checks
from tests.scenario import order_table


def run(spark, source, target, **config):
    return validate(spark.createDataFrame(source), spark.createDataFrame(target), Comparison(**config))


def counts(report) -> tuple:
    s = report.summary
    return s["total_checks"], s["passed"], s["failed"], s["skipped"], s["pass_rate"]


def failed(report) -> set[str]:
    return {c.name for c in report.check_rows if c.status == "FAILED"}


def skipped(report) -> set[str]:
    return {c.name for c in report.check_rows if c.status == "SKIPPED"}


def test_identical_tables_pass(spark):
    r = run(
        spark,
        order_table(300),
        order_table(300, shuffled=True),
        key=["order_id"],
        totals=Totals(["revenue", "qty"], ["region"]),
    )
    assert (r.overall_status, counts(r)) == ("PASSED", (18, 17, 0, 1, 1.0))
    profile = r.check("per_column_statistics").details["column_profiles"]
    for column in ("qty", "revenue"):
        got, values = profile[column]["source"], order_table(300)[column]
        assert got["mean"] == pytest.approx(values.mean()) and got["stddev"] == pytest.approx(values.std())
        assert (got["min"], got["max"]) == (values.min(), values.max())
        for p in (50, 95, 99):
            assert got[f"p{p}"] == pytest.approx(values.quantile(p / 100))


def test_noise_within_tolerance_fails_only_the_digests(spark):
    r = run(
        spark,
        order_table(300),
        order_table(300, noise=0.004),
        totals=Totals(["revenue"]),
        tolerances=Tolerances({"revenue": Margin(0.01, 0.01)}, Margin(0.01, 0.01)),
        statistics=Statistics(drift=0.05),
    )
    assert (r.overall_status, counts(r)) == ("FAILED", (18, 12, 3, 3, 0.8))
    assert failed(r) == {"full_dataset_hash", "column_level_hash", "bucketed_checksum"}
    assert r.check("column_level_hash").details["mismatched_columns"] == ["revenue"]


def test_dropped_rows_end_layer_two_early(spark):
    r = run(spark, order_table(300), order_table(300, drop=15))
    assert (r.overall_status, counts(r)) == ("FAILED", (13, 5, 5, 3, 0.5))
    assert r.layer_status("1_structural") == "PASSED" and len(r.layers) == 4
    assert [c.name for c in r.layers["2_data_level"]] == ["row_count"]
    assert r.check("row_count").details["delta"] == 15
    assert 0 < r.check("distribution_confidence").details["score"] < 1


def test_extra_column_stops_at_layer_one(spark):
    r = run(spark, order_table(100), order_table(100, extra=True))
    assert (r.overall_status, counts(r)) == ("FAILED", (2, 0, 2, 0, 0.0))
    assert list(r.layers) == ["1_structural"]
    assert r.check("column_names").details["extra_in_target"] == ["unplanned"]


def test_without_key_the_row_diff_is_skipped(spark):
    r = run(spark, order_table(200), order_table(200))
    assert (r.overall_status, counts(r)) == ("PASSED", (18, 14, 0, 4, 1.0))
    assert "row_aligned_diff" in skipped(r)


def test_without_aggregation_columns_totals_are_skipped(spark):
    r = run(spark, order_table(200), order_table(200), totals=Totals(within=["region"]))
    assert {"grand_total_aggregations", "group_by_consistency"} <= skipped(r)
    assert all(c.skipped_reason for c in r.check_rows if c.status == "SKIPPED")


def test_broken_rule(spark):
    target = order_table(200)
    target.loc[:10, "revenue"] = -999.0
    rule = Rule("revenue_positive", "SELECT min(revenue) FROM {table}")
    r = run(spark, order_table(200), target, rules=[rule])
    assert (r.overall_status, counts(r)) == ("FAILED", (18, 7, 8, 3, 0.4667))
    assert r.check("rule_revenue_positive").details["target"] == -999
    before, after = order_table(200)["revenue"], target["revenue"]
    # Seven figures of each of three numeric columns; those of revenue are the ones that can move.
    assert 0 < r.check("distribution_confidence").details["score"] < 1
    (issue,) = r.check("cardinality").details["issues"]
    assert (issue["column"], issue["source_cardinality"], issue["target_cardinality"]) == ("revenue", before.nunique(), after.nunique())
    (gap,) = r.check("float_tolerance").details["issues"]
    x, y = before.sort_values().to_numpy(), after.sort_values().to_numpy()
    assert gap["max_absolute_diff"] == pytest.approx(abs(x - y).max()) and gap["max_relative_diff"] == pytest.approx((abs(x - y) / abs(x)).max())


def test_row_and_cell_differences_are_complete(spark):
    target = order_table(100)
    target.loc[40:89, "revenue"] += 1
    r = run(spark, order_table(100), target, key=["order_id"])
    details = r.check("row_aligned_diff").details
    assert details["differing_keys"] == 50
    assert {row["order_id"] for row in details["sample"]} == {f"P-{i:05d}" for i in range(40, 60)}
    assert r.row_diff().count() == 50
    cells = r.cell_diff().collect()
    assert len(cells) == 50 and {c["column"] for c in cells} == {"revenue"}


def test_unknown_key_fails_and_unknown_totals_are_reported(spark):
    r = run(
        spark,
        order_table(50),
        order_table(50),
        key=["nope"],
        totals=Totals(["nope", "qty"], ["region"]),
    )
    assert failed(r) == {"row_aligned_diff", "grand_total_aggregations"}
    assert r.check("group_by_consistency").details["ignored_columns"] == ["nope"]


def test_unknown_group_column_fails_its_check_only(spark):
    r = run(spark, order_table(50), order_table(50), totals=Totals(["qty"], ["nope"]))
    assert failed(r) == {"group_by_consistency"}


def test_column_order_is_checked_on_request(spark):
    table = order_table(20)
    assert failed(run(spark, table, table[table.columns[::-1]], ordered=True)) == {"column_order"}
    assert run(spark, table, table[table.columns[::-1]]).passed


def test_types_and_nulls_gate(spark):
    source = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    wider = source.selectExpr("CAST(k AS bigint) AS k", "v")
    assert validate(source, wider).passed
    other = source.selectExpr("CAST(k AS string) AS k", "v")
    assert failed(validate(source, other)) == {"data_types"}
    filled = source.selectExpr("k", "coalesce(v, 'b') AS v")
    gaps = validate(source, filled)
    assert failed(gaps) == {"null_counts"} and list(gaps.layers) == ["1_structural"]


def test_no_numeric_columns_end_layer_four(spark):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    r = validate(df, df)
    assert r.passed and {"statistical_profile", "float_tolerance"} <= skipped(r)


def test_empty_tables_are_equal(spark):
    df = spark.createDataFrame([], "k int, v double, s string")
    r = validate(df, df, Comparison(key=["k"], totals=Totals(["v"], ["s"])))
    assert r.passed, failed(r)


def test_all_null_column_agrees_with_itself(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, v double")
    r = validate(df, df, Comparison(key=["k"], totals=Totals(["v"])))
    assert r.passed, failed(r)


def test_rule_forms_and_faults(spark):
    from pyspark.sql import functions as F

    rules = [
        Rule("sql", "sum(qty)"),
        Rule("column", lambda df: F.max("qty")),
        Rule("frame", lambda df: df.groupBy().count()),
        Rule("scalar", lambda df: len(df.columns)),
        Rule("text", "min(region)"),
        Rule("broken", "sum(no_such_column)"),
        Rule("raises", lambda df: 1 / 0),
        Rule("late", "sum(CAST(region AS int))"),
        Rule("many", "SELECT qty FROM {table}"),
        Rule("wide", "SELECT sum(qty), min(qty) FROM {table}"),
        Rule("none", "SELECT qty FROM {table} WHERE qty < 0"),
    ]
    r = run(spark, order_table(30), order_table(30), rules=rules)
    assert failed(r) == {"rule_broken", "rule_raises", "rule_late", "rule_many", "rule_wide"}
    assert "several rows" in r.check("rule_many").message
    assert "ZeroDivisionError" in r.check("rule_raises").message or "division by zero" in r.check("rule_raises").message


def test_a_crashing_layer_does_not_end_the_run(spark, monkeypatch):
    from concordat.operators import cardinality

    def crash(*_args, **_kwargs):
        raise RuntimeError("out of order")

    monkeypatch.setattr(cardinality, "cardinality", crash)
    r = run(spark, order_table(20), order_table(20, noise=0.1))
    (only,) = r.layers["4_statistical"]
    assert only.name == "layer_execution_error" and "out of order" in only.message
    assert len(r.layers) == 4 and r.check("float_tolerance").details["issues"]


def test_what_the_digests_settle_equals_the_full_checks(spark, monkeypatch):
    from concordat.plans.jobs import Jobs

    target = order_table(120)
    target.loc[5:50, "revenue"] += 3
    config = dict(key=["order_id"], totals=Totals(["qty"], ["region"]))
    statuses = lambda r: [(c.name, c.status, c.message) for c in r.check_rows]
    profiles = lambda r: r.check("per_column_statistics").details["column_profiles"]
    for other in (target, order_table(120)):
        short = run(spark, order_table(120), other, **config)
        with monkeypatch.context() as m:
            m.setattr(Jobs, "alike", lambda self, columns: (False, []))
            full = run(spark, order_table(120), other, **config)
        assert statuses(short) == statuses(full) and profiles(short) == profiles(full)


def test_layers_may_be_picked(spark):
    table = order_table(60)
    full = run(spark, table, order_table(60, noise=0.1), totals=Totals(["revenue"], ["region"]))
    for layers in (["1_structural"], ["3_business_rules"], ["4_statistical"], ["2_data_level", "4_statistical"]):
        some = run(spark, table, order_table(60, noise=0.1), totals=Totals(["revenue"], ["region"]), layers=layers)
        assert list(some.layers) == layers
        assert [(c.name, c.status) for c in some.check_rows] == [(c.name, c.status) for x in layers for c in full.layers[x]]
    # A table that does not fit fails the first layer, asked for or not.
    assert list(run(spark, table, order_table(60, extra=True), layers=["4_statistical"]).layers) == ["1_structural"]


def test_load_error_is_a_failed_report(spark):
    r = validate("/nowhere/a.csv", "/nowhere/b.csv", spark=spark)
    assert r.overall_status == "FAILED" and r.load_error and r.check("load_error").status == "FAILED"


def test_csv_paths_are_loaded_and_normalised(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order Id;Montant-HT;Note\n1;10.5; x \n2;N/A;null\n3;12;y\n")
    (tmp_path / "b.csv").write_text("order_id|montant_ht|note\n3|12.0|y\n1|10.5|x\n2||\n")
    r = validate(str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), Comparison(key=["order_id"]), spark)
    assert r.passed, [(c.name, c.message) for c in r.check_rows if c.status == "FAILED"]


def test_materialised_inputs_and_report_roundtrip(spark, tmp_path):
    s = spark.createDataFrame(order_table(40))
    r = validate(s, s, Comparison(run="again"), materialised=True)
    path = str(tmp_path / "checks")
    r.save(path)
    back = read_checks(spark, path)
    assert back.count() == len(r.check_rows)
    row = reports.summarise(back).first()
    assert row["equivalent"] and row["pass_rate"] == r.summary["pass_rate"]
    assert row["layer_statuses"] == r.summary["layer_statuses"]
    assert json.loads(back.where("check_name = 'row_count'").first()["details"])["source_rows"] == 40
    write_checks(r.checks, path)
    assert read_checks(spark, path).count() == 2 * len(r.check_rows)


def test_run_id_defaults_to_utc_time():
    assert len(Comparison().run_name()) == 15 and Comparison(run="x").run_name() == "x"
