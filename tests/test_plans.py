"""Steps, the payment job, outputs, many comparisons, completeness, query plans."""

from __future__ import annotations

import csv

import pytest

from concordat import Comparison, Totals
from concordat.operators import cardinality, keyed_diff, order_stats, profile
from concordat.operators.pairing import align
from concordat.plans import multi, payment_status, star_schema, steps
from concordat.plans.report import overall_status
from concordat.plans.validate import validate
from concordat.session import scratch_root
from concordat.sinks import staging
from concordat.sinks import tables as sinks
from concordat.sinks.reports import ERROR_SCHEMA, header_path
from concordat.sources import csv_tables
from concordat.sources.reports import read_checks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


# --- steps ------------------------------------------------------------------------------


def test_steps_run_in_order_and_the_last_of_a_name_wins(spark):
    out = steps.run_steps(
        spark,
        [("a", "SELECT 1 AS x UNION ALL SELECT 2"), ("b", "SELECT sum(x) AS s FROM a"), ("a", "SELECT x + 10 AS x FROM a")],
    )
    assert list(out) == ["b", "a"]
    assert out["b"].first()["s"] == 3 and sorted(r["x"] for r in out["a"].collect()) == [11, 12]


def test_named_outputs_only(spark):
    chain = [("a", "SELECT 1 AS x"), ("b", "SELECT x FROM a")]
    assert list(steps.run_steps(spark, chain, outputs=["b"])) == ["b"]
    with pytest.raises(KeyError):
        steps.run_steps(spark, chain, outputs=["c"])


def test_failing_step_is_logged_and_raised(spark, tmp_path):
    log = str(tmp_path / "errors")
    with pytest.raises(Exception, match="no_such_table"):
        steps.run_steps(spark, [("a", "SELECT 1 AS x"), ("b", "SELECT * FROM no_such_table")], error_log=log)
    row = spark.read.schema(ERROR_SCHEMA).json(log).first()
    assert (row["step"], row["statement"]) == ("b", "SELECT * FROM no_such_table") and row["traceback"]


def test_no_steps_and_bad_names(spark):
    with pytest.raises(RuntimeError):
        steps.run_steps(spark, [])
    with pytest.raises(ValueError):
        steps.run_steps(spark, [("drop table", "SELECT 1")])


# --- the payment job end to end ---------------------------------------------------------

INVOICES = [
    ("NXS", f"INV-{i:03d}", f"V{i % 4}", f"{100 + i * 1.25:.2f}", ["T0", "T5", "T9"][i % 3], "20260101", "20260201", "T", "", s, "EUR")
    for i, s in enumerate(["PAID"] * 25 + ["PENDING"] * 15 + ["BLOCKED"] * 10 + ["CANCELLED"] * 10)
]
# Field names of the workload, and its one statement.
INVOICE_FIELDS = "BUKRS,BELNR,SAP_VENDOR_ID,WRBTR,MWSKZ,BLDAT,ZFBDT,ZLSCH,AUGDT,PAYMENT_STATUS_RAW,WAERS"
SQL = """
SELECT s.belnr AS invoice_id, v.vendor_name, s.payment_status_raw AS payment_status, s.wrbtr AS gross_amount, t.tax_rate,
       round(CAST(s.wrbtr AS decimal(18,2)) * (1 - CAST(t.tax_rate AS decimal(6,4))), 2) AS net_amount
FROM invoices s LEFT JOIN vendors v ON s.sap_vendor_id = v.sap_vendor_id LEFT JOIN taxes t ON s.mwskz = t.tax_code
WHERE s.payment_status_raw IN ('PAID', 'PENDING') ORDER BY s.belnr LIMIT 50"""


def inputs(tmp_path, taxes: str) -> tuple[str, str]:
    types = {"wrbtr": "REAL"}
    ddl = lambda names: "column_name,type\n" + "".join(f"{n},{types.get(n, 'TEXT')}\n" for n in names)
    write(tmp_path / "ddl" / "invoices.csv", ddl(INVOICE_FIELDS.lower().split(",")))
    write(tmp_path / "ddl" / "vendors.csv", ddl(["sap_vendor_id", "vendor_name"]))
    write(tmp_path / "ddl" / "taxes.csv", "column_name,type\ntax_code,TEXT\ntax_rate,\"DECIMAL(6,4)\"\n")
    write(tmp_path / "data" / "invoices.csv", INVOICE_FIELDS + "\n" + "\n".join(map(",".join, INVOICES)) + "\n")
    write(tmp_path / "data" / "vendors.csv", "SAP_VENDOR_ID,VENDOR_NAME\nV0,Zero\nV1,One\nV2,Two\n")
    write(tmp_path / "data" / "taxes.csv", "tax_code,tax_rate\n" + taxes)
    return str(tmp_path / "data"), str(tmp_path / "ddl")


@pytest.mark.parametrize("taxes, rated", [("T0,0.00\nT5,0.05\n", 27), ("", 0)])
def test_pipeline_with_and_without_tax_rows(spark, tmp_path, taxes, rated):
    data, ddl = inputs(tmp_path, taxes)
    run = steps.execute(spark, [("payments", SQL)], data, ddl, str(tmp_path / "out"), extra_csv_paths={"payments": str(tmp_path / "again.csv")})
    df = run.outputs["payments"]
    assert list(run.schemas) == ["invoices", "taxes", "vendors"] and run.previews["payments"].rows == 40
    assert df.where("tax_rate IS NOT NULL AND net_amount IS NOT NULL").count() == rated
    assert df.where("vendor_name IS NULL").count() == 10
    if rated:
        assert str(df.where("invoice_id = 'INV-001'").first()["net_amount"]) == "96.19"
    for path in run.written["payments"]:
        assert spark.read.option("header", True).csv(path).count() == 40
    # A second run replaces the first.
    steps.execute(spark, [("payments", SQL)], data, ddl, str(tmp_path / "out"), show=False)
    assert spark.read.parquet(str(tmp_path / "out" / "payments.parquet")).count() == 40


def test_pipeline_without_schemas_and_published(spark, tmp_path):
    write(tmp_path / "data" / "nums.csv", "A\n1\n2\n")
    out = str(tmp_path / "out")
    for run_id, floor in (("one", 0), ("two", 1)):
        run = steps.execute(spark, [("big", f"SELECT a FROM nums WHERE a > {floor}")], str(tmp_path / "data"), output_dir=out, publish_as=run_id)
    assert run.schemas["nums"].names == ["a"]
    assert [r["a"] for r in sinks.read_published(spark, f"{out}/published", "big").collect()] == ["2"]
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, f"{out}/published", "small")
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, f"{out}/nothing", "big")


def test_payment_plan_function_equals_its_sql(spark, sf_dir):
    invoices, vendors, rates = star_schema.payment_inputs(spark, sf_dir)
    full = payment_status.payment_status(invoices, vendors, rates, limit=None)
    assert full.columns == payment_status.OUTPUT_COLUMNS
    assert full.count() == invoices.where("payment_status_raw IN ('PAID', 'PENDING')").count()
    assert payment_status.payment_status(invoices, vendors, rates).count() == 50


# --- sinks ------------------------------------------------------------------------------


def test_outputs_overwrite_and_copies(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "i int, s string")
    out, extra = str(tmp_path / "out"), str(tmp_path / "deep" / "copy.csv")
    for persist in (True, False, True):
        written = sinks.save_outputs({"t": df}, out, {"t": extra}, persist=persist)
    assert written["t"] == [f"{out}/t.csv", extra]
    assert spark.read.parquet(f"{out}/t.parquet").count() == 2
    back = {r["i"]: r["s"] for r in spark.read.option("header", True).option("escape", '"').csv(extra).collect()}
    assert back == {"1": 'a "b", c', "2": None}
    assert sinks.save_outputs({}, out) == {}


def test_catalog_table_is_replaced(spark):
    df = spark.range(3)
    sinks.persist_table(df, name="concordat_numbers")
    sinks.persist_table(df.limit(1), name="concordat_numbers")
    assert spark.table("concordat_numbers").count() == 1
    spark.sql("DROP TABLE concordat_numbers")


def test_preview(spark):
    p = sinks.preview(spark.range(60))
    assert (p.rows, len(p.head), p.more) == (60, 50, 10)
    assert sinks.preview(spark.range(5)).more == 0


def test_fixture_layout(spark, tmp_path):
    rows = [{"a": 1, "b": None}, {"a": 2, "b": "x,y"}]
    path = sinks.write_fixture(spark, rows, str(tmp_path), "maker", "orders", "input")
    assert path == f"{tmp_path}/maker/orders/input.csv"
    parts = list((tmp_path / "maker" / "orders" / "input.csv").glob("part-*.csv"))
    with open(parts[0], newline="") as f:
        assert list(csv.reader(f)) == [["a", "b"], ["1", ""], ["2", "x,y"]]
    assert sinks.write_fixture(spark, [], str(tmp_path), "maker", "none", "input") is None


class Session:
    """Only what ``scratch_root`` asks a session for."""

    def __init__(self, configured, master):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_scratch_follows_the_session_setting(spark):
    assert scratch_root(Session("hdfs://shared/dir/", "yarn")) == "hdfs://shared/dir"
    with pytest.raises(RuntimeError):
        scratch_root(Session(None, "yarn"))
    assert scratch_root(spark) == scratch_root(spark)


# --- many comparisons -------------------------------------------------------------------


def test_compare_many(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 3.0)], "k int, v double")
    path = str(tmp_path / "reports")
    both = multi.compare_many(spark, [("same", a, a), ("other", b, a)], Comparison(run="m"), path)
    assert not both.success and [r.passed for r in both.reports] == [True, False]
    assert {(r["run_id"], r["comparison"]) for r in spark.read.json(path).select("run_id", "comparison").collect()} == {("m", "same"), ("m", "other")}
    assert multi.compare_many(spark, [("same", a, a)]).success
    assert not multi.compare_many(spark, []).success


def test_a_run_that_broke_off_goes_on(spark, tmp_path, monkeypatch):
    """Killed after two of four; begun again it validates the other two, and a third time none but what changed."""
    pairs = []
    for i in range(4):
        a = write(tmp_path / "out" / f"t{i}.csv", "k,v\n" + "".join(f"{j},{j + i}\n" for j in range(30)))
        b = write(tmp_path / "want" / f"t{i}.csv", "k,v\n" + "".join(f"{j},{j + i + (i == 1)}\n" for j in range(30)))
        pairs.append((f"t{i}", a, b))
    path, cfg, seen = str(tmp_path / "checks"), Comparison(run="r1"), []
    plain = multi.validate

    def counted(source, target, config, session):
        if len(seen) == 2 and dies:
            raise KeyboardInterrupt
        seen.append(config.name)
        return plain(source, target, config, session)

    monkeypatch.setattr(multi, "validate", counted)
    dies = True
    with pytest.raises(KeyboardInterrupt):
        multi.compare_many(spark, pairs, cfg, path, at_once=1)
    assert seen == ["t0", "t1"]
    dies = False
    found = multi.compare_many(spark, pairs, cfg, path, at_once=2)
    assert sorted(seen) == ["t0", "t1", "t2", "t3"] and found.resumed == ["t0", "t1"] and not found.success
    status = {(r["comparison"], r["status"]) for r in overall_status(found.checks).collect()}
    assert status == {("t0", "PASSED"), ("t1", "FAILED"), ("t2", "PASSED"), ("t3", "PASSED")}
    # Every row was written once, as its comparison ended.
    saved = read_checks(spark, path)
    assert saved.count() == found.checks.count() and saved.exceptAll(found.checks).isEmpty()
    write(tmp_path / "out" / "t2.csv", "k,v\n1,2\n")
    again = multi.compare_many(spark, pairs, cfg, path)
    assert seen[4:] == ["t2"] and again.resumed == ["t0", "t1", "t3"]
    # Rows that are not in files are validated every time.
    rows = [("r", spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "a int"))]
    for _ in range(2):
        assert multi.compare_many(spark, rows, cfg, path).resumed == []
    stored = spark.read.parquet(sinks_path(spark, tmp_path))
    for expect in ([], ["p"]):
        assert multi.compare_many(spark, [("p", stored.where("id > 1"), stored)], Comparison(run="r2"), path).resumed == expect
    assert multi.compare_many(spark, [("p", stored.where("id > 2"), stored)], Comparison(run="r2"), path).resumed == []


def sinks_path(spark, tmp_path):
    sinks.persist_table(spark.range(9), path=str(tmp_path / "stored"))
    return str(tmp_path / "stored")


def test_pairs_are_discovered_by_name(spark, tmp_path):
    for side, names in (("out", "ab"), ("expected", "bc")):
        for n in names:
            write(tmp_path / side / f"{n}.csv", "k,v\n1,2\n")
    pairs = multi.discover_pairs(spark, str(tmp_path / "out"), str(tmp_path / "expected"))
    assert [(p[0], p[1] is None, p[2] is None) for p in pairs] == [("a", False, True), ("b", False, False), ("c", True, False)]
    found = multi.compare_many(spark, pairs)
    assert not found.success and [r.passed for r in found.reports] == [False, True, False]
    assert [r["check_name"] for r in found.checks.where("status = 'FAILED'").orderBy("comparison").collect()] == ["missing_expected", "missing_output"]


def test_a_broken_path_is_a_failed_row(spark, tmp_path):
    good = write(tmp_path / "g.csv", "k,v\n1,2\n")
    path = str(tmp_path / "reports")
    found = multi.compare_many(spark, [("good", good, good), ("bad", str(tmp_path / "none.csv"), good)], Comparison(run="p"), path)
    assert not found.success
    rows = {r["comparison"]: r["status"] for r in overall_status(spark.read.json(path)).collect()}
    assert rows == {"good": "PASSED", "bad": "FAILED"}
    heads = {r["comparison"]: r for r in spark.read.json(header_path(path)).collect()}
    assert heads["bad"]["overall_status"] == "FAILED" and heads["bad"]["load_error"] and heads["good"]["run_id"] == "p"


def test_one_sided_tables_fail_a_phase(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    result = multi.validate_two_phases(spark, {"a": a, "b": a}, {"only_a": {"a": a}})
    assert result.status == "failure"


def test_different_text_in_a_date_column_differs(spark, tmp_path):
    rows = lambda word: "id,update_note\n" + "".join(f"{i},{word} {i}\n" for i in range(30))
    r = validate(write(tmp_path / "a.csv", rows("left")), write(tmp_path / "b.csv", rows("right")), Comparison(key=["id"]), spark)
    assert r.overall_status == "FAILED" and r.check("type_conversion").details["values_that_would_be_lost"]["update_note"] == {"source": 30, "target": 30}


def test_equal_days_in_two_spellings_are_equal(spark, tmp_path):
    days = [f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}" for i in range(30)]
    turned = ["/".join(reversed(d.split("-"))) for d in days]
    a = write(tmp_path / "a.csv", "k,day\n" + "".join(f"{i},{d}\n" for i, d in enumerate(turned)))
    b = write(tmp_path / "b.csv", "k;day\n" + "".join(f"{i};{d}\n" for i, d in enumerate(days)))
    assert validate(a, b, spark=spark).overall_status == "PASSED"
    c = write(tmp_path / "c.csv", "k,day\n" + "".join(f"{i},{d}\n" for i, d in enumerate([*days[:-1], "2024-01-01"])))
    assert validate(a, c, spark=spark).overall_status == "FAILED"


def test_files_that_differ_in_a_surplus_cell_only(spark, tmp_path):
    a = write(tmp_path / "a.csv", "k,v\n1,2\n3,4\n")
    b = write(tmp_path / "b.csv", "k,v\n1,2\n3,4,LOST\n")
    report = validate(a, b, spark=spark)
    assert report.overall_status == "FAILED" and report.check("load_error").status == "FAILED" and "LOST" in report.load_error


def test_separators_are_counted_over_all_lines(spark, tmp_path):
    text = "a;b\n" + "one, two, three; x\n" * 3 + "plain;y\n" * 5000
    assert csv_tables.detect_delimiter(spark, write(tmp_path / "t.csv", text)) == ";"


def test_outputs_never_replace_inputs_and_old_ones_go(spark, tmp_path):
    write(tmp_path / "data" / "orders.csv", "a\n1\n2\n")
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    with pytest.raises(ValueError, match="over inputs"):
        steps.execute(spark, [("orders", "SELECT 1 AS a")], data)
    assert (tmp_path / "data" / "orders.csv").read_text() == "a\n1\n2\n"
    steps.execute(spark, [("one", "SELECT * FROM orders"), ("two", "SELECT 2 AS b")], data, output_dir=out)
    steps.execute(spark, [("one", "SELECT * FROM orders")], data, output_dir=out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith((".", "_"))) == ["one.csv", "one.parquet"]
    with pytest.raises(Exception, match="nowhere"):
        steps.execute(spark, [("one", "SELECT * FROM nowhere")], data, output_dir=out)
    # A failed run leaves what stood.
    assert spark.read.option("header", True).csv(f"{out}/one.csv").count() == 2


def test_a_job_runs_again_in_its_default_folder(spark, tmp_path):
    write(tmp_path / "orders.csv", "a\n1\n2\n")
    data = str(tmp_path)
    for floor, rows in ((0, 2), (1, 1)):
        run = steps.execute(spark, [("x", f"SELECT * FROM orders WHERE a > {floor}")], data)
        assert list(run.schemas) == ["orders"] and run.outputs["x"].count() == rows
    assert spark.read.option("header", True).csv(f"{data}/x.csv").count() == 1


def test_a_second_job_reads_what_the_first_made(spark, tmp_path):
    write(tmp_path / "orders.csv", "a\n1\n2\n")
    data = str(tmp_path)
    first, second = [("x", "SELECT a FROM orders")], [("y", "SELECT count(*) AS n FROM x")]
    steps.execute(spark, first, data)
    assert steps.execute(spark, second, data).outputs["y"].first()["n"] == 2
    # Neither job takes the other's outputs for its own, in any order of runs.
    write(tmp_path / "orders.csv", "a\n1\n2\n3\n")
    steps.execute(spark, first, data)
    assert steps.execute(spark, second, data).outputs["y"].first()["n"] == 3
    assert {p.name for p in tmp_path.iterdir() if p.suffix in (".csv", ".parquet")} == {"orders.csv", "x.csv", "x.parquet", "y.csv", "y.parquet"}
    with pytest.raises(ValueError, match="other jobs"):
        steps.execute(spark, [("x", "SELECT 1 AS a"), ("y", "SELECT 2 AS n")], str(tmp_path / "none"), output_dir=data)
    with pytest.raises(ValueError, match="other jobs"):
        steps.execute(spark, [("x", "SELECT 1 AS a")], str(tmp_path / "none"), output_dir=data, job="mine")


def test_no_view_of_an_earlier_run_is_read(spark, tmp_path):
    write(tmp_path / "one" / "only_here.csv", "a\n1\n")
    write(tmp_path / "two" / "other.csv", "a\n1\n")
    spark.range(7).createOrReplaceTempView("standing")
    steps.execute(spark, [("x", "SELECT * FROM only_here"), ("standing", "SELECT 1 AS a")], str(tmp_path / "one"))
    for name in ("x", "only_here"):
        with pytest.raises(Exception, match=name):
            steps.execute(spark, [("y", f"SELECT * FROM {name}")], str(tmp_path / "two"))
    assert spark.table("standing").count() == 7
    assert not (tmp_path / "two" / "y.csv").exists()
    spark.catalog.dropTempView("standing")


def failing(spark, rows):
    return spark.range(rows).selectExpr(f"CASE WHEN id = {rows - 1} THEN raise_error('no') ELSE id END AS id")


def test_a_failing_overwrite_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.persist_table(spark.range(5), "concordat_kept", path)
    with pytest.raises(Exception, match="no"):
        sinks.persist_table(failing(spark, 9), path=path)
    with pytest.raises(Exception, match="no"):
        sinks.persist_table(failing(spark, 9), "concordat_kept")
    assert spark.read.parquet(path).count() == spark.table("concordat_kept").count() == 5
    # A table may be made from what it replaces.
    sinks.persist_table(spark.read.parquet(path).where("id > 1"), path=path)
    sinks.persist_table(spark.table("concordat_kept").where("id > 1"), "concordat_kept")
    assert spark.read.parquet(path).count() == spark.table("concordat_kept").count() == 3
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith((".", "_"))] == ["t"]
    spark.sql("DROP TABLE concordat_kept")


def test_outputs_are_replaced_together(spark, tmp_path):
    out, extra = str(tmp_path / "out"), str(tmp_path / "far" / "copy.csv")
    sinks.save_outputs({"a": spark.range(2), "b": spark.range(3)}, out, {"a": extra}, job="j")
    with pytest.raises(Exception, match="no"):
        sinks.save_outputs({"a": spark.range(20), "b": failing(spark, 4)}, out, {"a": extra}, job="j")
    assert [spark.read.parquet(f"{out}/{n}.parquet").count() for n in "ab"] == [2, 3]
    assert spark.read.option("header", True).csv(extra).count() == 2


def test_others_commits_are_left_alone(spark, tmp_path):
    """Two writers in one folder: neither clears away what the other has not yet committed."""
    out = f"file:{tmp_path}"
    with staging.Staged(spark, out, "j-2") as other:
        spark.range(3).write.parquet(other.place(f"{out}/a"))
        with staging.Staged(spark, out, staging.job_of([f"{out}/b"])) as mine:
            sinks.persist_table(spark.range(5), path=f"{out}/c")
            sinks.save_outputs({"d": spark.range(2)}, out, job="j")
            spark.range(4).write.parquet(mine.place(f"{out}/b"))
            mine.commit()
        assert staging.recover(spark, out, "j") == 0
        other.commit()
    assert [spark.read.parquet(f"{out}/{n}").count() for n in "abc"] == [3, 4, 5]


@pytest.mark.parametrize("moves", range(9))
def test_an_interrupted_commit_is_carried_to_its_end(spark, tmp_path, monkeypatch, moves):
    """A process that dies after any number of moves; the next run finds everything old or everything new."""
    out, extra = str(tmp_path / "out"), str(tmp_path / "far" / "copy.csv")
    sinks.save_outputs({"a": spark.range(2), "b": spark.range(3)}, out, {"a": extra}, job="j")
    left, plain = [moves], staging.move

    def dies(*args):
        if not left[0]:
            raise KeyboardInterrupt
        left[0] -= 1
        plain(*args)

    monkeypatch.setattr(staging, "move", dies)
    try:
        sinks.save_outputs({"a": spark.range(20)}, out, {"a": extra}, job="j")
        assert moves >= 6
    except KeyboardInterrupt:
        assert moves < 6
    monkeypatch.setattr(staging, "move", plain)
    staging.recover(spark, f"file:{out}", "j")
    assert spark.read.parquet(f"{out}/a.parquet").count() == 20
    assert [spark.read.option("header", True).csv(p).count() for p in (f"{out}/a.csv", extra)] == [20, 20]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith((".", "_"))) == ["a.csv", "a.parquet"]
    assert list((tmp_path / "out" / "_staging").iterdir()) == [] and staging.Ledger(spark, out).owners().keys() == {
        f"file:{p}" for p in (f"{out}/a.csv", f"{out}/a.parquet", extra)
    }


def test_a_failed_republish_keeps_the_published_tables(spark, tmp_path):
    root = str(tmp_path)
    sinks.publish_run(spark, {"t": spark.range(3)}, root, "r")
    with pytest.raises(Exception):
        sinks.publish_run(spark, {"t": spark.range(3).selectExpr("raise_error('no') AS id")}, root, "r")
    assert sinks.read_published(spark, root, "t").count() == 3
    sinks.publish_run(spark, {"t": spark.range(5)}, root, "r")
    assert sinks.read_published(spark, root, "t").count() == 5


def test_all_wrong_groups_are_there(spark):
    a = spark.createDataFrame([(i, 1.0) for i in range(50)], "g int, v double")
    b = spark.createDataFrame([(i, 2.0) for i in range(50)], "g int, v double")
    r = validate(a, b, Comparison(totals=Totals(["v"], ["g"])))
    shown = r.check("group_by_consistency").details
    assert len(shown["shown"]["v"]) == 10 and shown["sample_truncated"] and r.group_differences().count() == 50


@pytest.mark.parametrize(
    "first, second, want",
    [
        (True, True, ("success", "two", "two")),
        (False, True, ("success", "two", "two")),
        (True, False, ("success", "one", "one")),
        (False, False, ("failure", None, "two")),
    ],
)
def test_two_phases(spark, first, second, want):
    rows = spark.createDataFrame([("one", 1, first), ("two", 2, second)], multi.PHASES)
    assert tuple(multi.two_phase_verdict(rows).first()) == want


def test_two_phase_validation(spark):
    a, b = spark.range(3), spark.range(1, 4)
    out = multi.validate_two_phases(spark, {"t": a}, {"simulated": {"t": a}, "recorded": {"t": b}})
    assert (out.status, out.winning_phase) == ("success", "simulated")
    nothing = multi.validate_two_phases(spark, {"t": a}, {"simulated": {}, "recorded": {"t": b}})
    assert (nothing.status, nothing.winning_phase, nothing.reported_phase) == ("failure", None, "recorded")


def test_completeness(spark):
    full, empty = spark.range(2), spark.range(0)
    parts = {"schema": {"a": full, "b": full}, "data": {"a": full, "b": empty}}
    assert multi.is_complete(["a"], parts, spark)
    got = {tuple(r) for r in multi.completeness(["a", "b", "c"], parts, spark).collect()}
    assert got == {("b", "data", "empty"), ("c", "schema", "missing"), ("c", "data", "missing")}
    assert not multi.is_complete(["a"], {"data": {}}, spark)


# --- plans ------------------------------------------------------------------------------


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_product_no_single_task_window_and_prune_columns(spark, sf_dir):
    o = star_schema.orders(spark, sf_dir)
    pair = align(o, star_schema.changed_orders(o))
    frames = {
        "profile": profile.side_profile(pair),
        "ranks": order_stats.rank_differences(pair, pair.numeric_columns(), rows_per_bin=200),
        "percentiles": order_stats.column_percentiles(pair, pair.numeric_columns(), [0.5], rows_per_bin=200),
        "diff": keyed_diff.row_diff(pair, ["o_orderkey"]),
        "cardinality": cardinality.cardinality(pair),
    }
    for name, df in frames.items():
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name
        for line in text.splitlines():
            if "Exchange SinglePartition" in line:
                assert name != "ranks" and name != "percentiles", line
    one_column = order_stats.rank_differences(align(o.select("o_totalprice"), o.select("o_totalprice")), ["o_totalprice"], rows=1)
    assert "ReadSchema: struct<o_totalprice:double>" in plan(one_column)
    assert "SortMergeJoin" not in plan(frames["diff"]) and plan(frames["diff"]).count("Exchange") == 1
