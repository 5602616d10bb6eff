"""Schema files, CSV loading, types, constraints, separators, normalisation."""

from __future__ import annotations

import datetime as dt
import random
import warnings
from collections import Counter

import pytest
from pyspark.sql import types as T

from concordat.functions.types import comparison_type, family, parse_type_token
from concordat.operators import normalise
from concordat.sources import csv_tables, records
from concordat.sources.constraints import constraint_violations
from concordat.sources.schema_files import comparison_hints, load_schema, load_schemas, primary_key


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, newline="")
    return str(path)


# --- schema files -----------------------------------------------------------------------


def test_type_tokens():
    assert parse_type_token("VARCHAR(255)") == (T.StringType(), "string")
    assert parse_type_token("BigInt") == (T.LongType(), "integer")
    assert parse_type_token("decimal(10, 3)") == (T.DecimalType(10, 3), "float")
    assert parse_type_token("NUMERIC") == (T.DoubleType(), "float")
    assert parse_type_token("timestamp") == (T.TimestampNTZType(), "datetime")
    assert parse_type_token("bool") == (T.BooleanType(), "boolean")
    with pytest.warns(UserWarning):
        assert parse_type_token("geometry", "shape") == (T.StringType(), "string")


def test_families_and_common_types():
    assert [family(t) for t in (T.ShortType(), T.DecimalType(5, 2), T.DateType(), T.TimestampType())] == ["integer", "float", "date", "datetime"]
    assert family(T.ArrayType(T.IntegerType())) == "array<int>"
    assert comparison_type(T.IntegerType(), T.LongType()) == T.LongType()
    assert comparison_type(T.DecimalType(10, 2), T.DecimalType(8, 4)) == T.DecimalType(12, 4)
    assert comparison_type(T.FloatType(), T.DoubleType()) == T.DoubleType()


def test_schema_file_and_hints(spark, tmp_path):
    path = write(tmp_path / "t.csv", " Column_Name ,TYPE,nullable,primary_key\nid,INT,false,true\nname,varchar(20),,\nat,DATE,no,maybe\n")
    schema = load_schema(spark, path, "t")
    assert [(f.name, f.dataType) for f in schema.fields] == [("id", T.IntegerType()), ("name", T.StringType()), ("at", T.DateType())]
    assert primary_key(schema) == ["id"]
    assert [f.metadata["nullable"] for f in schema.fields] == [False, True, False]
    assert comparison_hints(schema) == {"primary_key": ["id"], "column_types": {"id": "integer", "name": "string", "at": "date"}}


def test_schema_directory(spark, tmp_path):
    write(tmp_path / "b.csv", "column_name,type\nx,INT\n")
    write(tmp_path / "a.csv", "column_name,type,primary_key\ny,TEXT,1\n")
    write(tmp_path / "notes.txt", "not a schema")
    schemas = load_schemas(spark, str(tmp_path))
    assert list(schemas) == ["a", "b"] and primary_key(schemas["a"]) == ["y"] and primary_key(schemas["b"]) == []


def test_schema_faults(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_schemas(spark, str(tmp_path / "nowhere"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        load_schemas(spark, str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="type"):
        load_schema(spark, write(tmp_path / "bad.csv", "column_name,kind\na,INT\n"))
    with pytest.raises(ValueError, match="column_name"):
        load_schema(spark, write(tmp_path / "gap.csv", "column_name,type\n ,INT\n"))


# --- declared loading -------------------------------------------------------------------


def declared(spark, tmp_path, body, ddl="id,INT,false,true\nlabel,TEXT\n", **options):
    header = "column_name,type,nullable,primary_key\n"
    rows = "".join(line + "," * (3 - line.count(",")) + "\n" for line in ddl.strip().split("\n"))
    write(tmp_path / "ddl" / "t.csv", header + rows)
    write(tmp_path / "data" / "t.csv", body)
    write(tmp_path / "data" / "stranger.csv", "a,b\n1,2\n")
    return csv_tables.load_declared(spark, str(tmp_path / "data"), load_schemas(spark, str(tmp_path / "ddl")), **options)


def test_headers_are_trimmed_lowered_and_reordered(spark, tmp_path):
    loads = declared(spark, tmp_path, " LABEL , Id \r\nx,1\r\n,2\r\n")
    assert list(loads) == ["t"]
    df = loads["t"].rows
    assert df.columns == ["id", "label"] and df.schema["id"].metadata["primary_key"]
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, "")]


def test_quotes_and_line_breaks(spark, tmp_path):
    loads = declared(spark, tmp_path, 'id,label\n1,"a;""q"", b"\n2,"two\nlines"\n', multiline=True)
    assert sorted(map(tuple, loads["t"].rows.collect())) == [(1, 'a;"q", b'), (2, "two\nlines")]


def test_column_contract(spark, tmp_path):
    csv_tables.check_columns(["b", "a"], ["a", "b"], "t.csv")
    with pytest.raises(ValueError, match=r"t\.csv.*missing \['b'\].*unexpected \['c'\]"):
        csv_tables.check_columns(["a", "c"], ["a", "b"], "t.csv")
    with pytest.raises(ValueError, match="A"):
        csv_tables.check_columns(["A"], ["a"], "t.csv")
    with pytest.raises(ValueError):
        declared(spark, tmp_path, "id,label,more\n1,x,y\n")


def test_missing_file(spark, tmp_path):
    write(tmp_path / "ddl" / "gone.csv", "column_name,type\nid,INT\n")
    with pytest.raises(FileNotFoundError, match="gone"):
        csv_tables.load_declared(spark, str(tmp_path), load_schemas(spark, str(tmp_path / "ddl")))


DDL = "id,INT\nprice,\"DECIMAL(8,2)\"\nday,DATE\nat,TIMESTAMP\nok,BOOLEAN\nrate,DOUBLE\n"


def test_types_and_blanks(spark, tmp_path):
    body = "id,price,day,at,ok,rate\n1, 10.50 ,2024-02-29,2024-01-02 03:04:05,true,1e3\n,,,,,\n"
    write(tmp_path / "ddl" / "t.csv", "column_name,type\n" + DDL)
    write(tmp_path / "data" / "t.csv", body)
    df = csv_tables.load_declared(spark, str(tmp_path / "data"), load_schemas(spark, str(tmp_path / "ddl")))["t"].rows
    rows = [r for r in df.collect() if r["id"] == 1]
    assert tuple(rows[0])[2:] == (dt.date(2024, 2, 29), dt.datetime(2024, 1, 2, 3, 4, 5), True, 1000.0)
    assert str(rows[0]["price"]) == "10.50" and df.where("id IS NULL AND rate IS NULL AND ok IS NULL").count() == 1


def test_failfast_raises_and_quarantine_keeps_whole_rows(spark, tmp_path):
    body = "id,label\n1,a\nx,b\n2d,c\n3,\n"
    with pytest.raises(Exception, match="column id is not int: x|column id is not int: 2d"):
        declared(spark, tmp_path / "f", body)["t"].rows.collect()
    load = declared(spark, tmp_path / "q", body, mode="quarantine")["t"]
    assert sorted(r["id"] for r in load.rows.collect()) == [1, 3]
    assert sorted(tuple(r)[:3] for r in load.rejects.collect()) == [("2d", "c", ["id"]), ("x", "b", ["id"])]
    with pytest.raises(ValueError):
        declared(spark, tmp_path / "m", body, mode="other")


# --- records that do not fit their header, line breaks inside quotes ----------------------

RAGGED = 'id,label\r\n1,a\r\n2,b,LOST\r\n\r\n5\r\n"6","x ""y"", z"\r\nq,d\r\n7,"e",\r\n8,ü\r\n'


@pytest.mark.parametrize("options", [{}, {"multiline": True}])
def test_ragged_records_are_rejects_with_their_place(spark, tmp_path, options):
    load = declared(spark, tmp_path, RAGGED, mode="quarantine", **options)["t"]
    assert sorted(map(tuple, load.rows.collect())) == [(1, "a"), (6, 'x "y", z'), (8, "ü")]
    got = {r["record"]: r for r in load.rejects.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "2,b,LOST": "too wide: 3 cells for 2 columns",
        "5": "too narrow: 1 cells for 2 columns",
        '7,"e",': "too wide: 3 cells for 2 columns",
        "q,d": "not of the declared type: id",
    }
    raw = RAGGED.encode()
    for record, r in got.items():
        assert r["file"].endswith("/data/t.csv")
        assert raw[r["byte_offset"] :].startswith(record.encode() + b"\r\n")
    assert (got["q,d"]["id"], got["q,d"]["bad_columns"], got["5"]["id"], got["5"]["bad_columns"]) == ("q", ["id"], None, [])


@pytest.mark.parametrize("options", [{}, {"multiline": True}])
@pytest.mark.parametrize("line", ["2,b,LOST", "2", "2,b,"])
def test_ragged_records_stop_a_failfast_load(spark, tmp_path, line, options):
    body = f"id,label\n1,a\n{line}\n"
    rows = declared(spark, tmp_path, body, **options)["t"].rows
    for action in (rows.collect, rows.count, rows.select("label").collect):
        with pytest.raises(Exception, match="cells"):
            action()
    with pytest.raises(Exception, match="cells"):
        csv_tables.load_all_text(spark, str(tmp_path / "data"))["t"].count()
    with pytest.raises(Exception, match="cells"):
        csv_tables.load_inferred(spark, str(tmp_path / "data"))["t"].count()


def test_misfits_of_every_part(spark, tmp_path):
    write(tmp_path / "t.csv" / "a.csv", "k,v\n1,2\n3,4,5\n")
    write(tmp_path / "t.csv" / "b.csv", "k,v\n6\n7,8\n")
    got = {(r["file"].rsplit("/", 1)[1], r["byte_offset"], r["record"]) for r in csv_tables.misfits(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {("a.csv", 8, "3,4,5"), ("b.csv", 4, "6")}


def odd_cells(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "ß", "\n", "\r\n", '"', ",", " ", "\n\n", '""', "x" * 30]) for _ in range(rng.randint(0, 6)))
    return [(str(i), cell(), cell()) for i in range(n)]


def csv_text(rows: list[tuple]) -> str:
    quote = lambda c: '"' + c.replace('"', '""') + '"' if set(c) & set(' ,"\r\n') else c
    return "".join(",".join(map(quote, r)) + "\n" for r in [("id", "b", "c"), *rows])


@pytest.mark.parametrize("seed, split", [(1, 64), (2, 150), (3, 1000), (4, 128 << 20)])
def test_many_tasks_read_what_one_reads(spark, tmp_path, seed, split):
    """Splits that begin inside quotes, at doubled quotes, in the middle of records longer than several splits."""
    rows = odd_cells(seed, 300) + [("big", "line\n" * 200, '"\n"')] + odd_cells(seed + 10, 50)
    path, body = str(tmp_path / "t.csv"), csv_text(rows)
    write(tmp_path / "t.csv", body)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = csv_tables.read_text_columns(spark, path, multiline=True).collect()
        found = records.records(spark, path, multiline=True).collect()
        splits = records.lines(spark, path).select("split").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert splits > 1 or split > len(body)
    # What stands between quotes comes back as it was, line ends too.
    assert Counter(map(tuple, got)) == Counter(rows)
    one_task = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).count()
    assert len(got) == one_task
    raw = body.encode()
    for r in found:
        assert raw[r["byte_offset"] :].startswith(r["record"].encode())


def test_other_encodings(spark, tmp_path):
    body = 'id,label\n1,"größe\nÄ"\n2,é,x\n'
    (tmp_path / "t.csv").write_bytes(body.encode("latin-1"))
    got = csv_tables.read_text_columns(spark, str(tmp_path / "t.csv"), encoding="ISO-8859-1", multiline=True, strict=False).collect()
    assert list(map(tuple, got)) == [("1", "größe\nÄ")]
    lost = csv_tables.misfits(spark, str(tmp_path / "t.csv"), encoding="ISO-8859-1", multiline=True).collect()
    assert [(r["byte_offset"], r["record"]) for r in lost] == [(body.index("2,é"), "2,é,x")]
    with pytest.raises(ValueError):
        records.records(spark, str(tmp_path / "t.csv"), encoding="UTF-16")


def test_a_quote_that_never_closes(spark, tmp_path, monkeypatch):
    write(tmp_path / "t.csv", 'a,b\n1,"x\n2,y\n' + "3,zzzzzzzz\n" * 50)
    lost = csv_tables.misfits(spark, str(tmp_path / "t.csv"), multiline=True).collect()
    assert [(r["byte_offset"], r["reason"]) for r in lost] == [(4, "a quote that is not closed")]
    write(tmp_path / "u.csv", "\na,b\n1,2\n")
    with pytest.raises(Exception, match="blank line"):
        csv_tables.misfits(spark, str(tmp_path / "u.csv")).collect()


def test_constraints(spark, tmp_path):
    load = declared(spark, tmp_path, "id,label\n1,a\n1,b\n,c\n", ddl="id,INT,false,true\nlabel,TEXT,true,false\n")["t"]
    schema = load_schemas(spark, str(tmp_path / "ddl"))["t"]
    got = sorted(tuple(r) for r in constraint_violations(load.rows, schema).collect())
    assert got == [("not_null", "id", None, 1), ("primary_key", "id", "1", 2)]
    assert constraint_violations(load.rows.where("label <> 'b' AND id IS NOT NULL"), schema).isEmpty()


def test_composite_key(spark):
    key = {"primary_key": True}
    schema = T.StructType([T.StructField("a", T.IntegerType(), True, key), T.StructField("b", T.IntegerType(), True, key)])
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "a int, b int")
    assert [tuple(r) for r in constraint_violations(df, schema).collect()] == [("primary_key", "a,b", "1|2", 2)]


def test_keys_are_not_mixed_up(spark):
    key = {"primary_key": True}
    schema = T.StructType([T.StructField("a", T.StringType(), True, key), T.StructField("b", T.StringType(), True, key)])
    rows = [("x|y", "z"), ("x", "y|z"), ("null", "n"), (None, "n"), ("\\N", "n"), ("x\\", "y|z")] * 2
    found = constraint_violations(spark.createDataFrame(rows, "a string, b string"), schema).where("`constraint` = 'primary_key'")
    keys = [r["key"] for r in found.collect()]
    assert len(keys) == len(set(keys)) == 6 and "x\\|y|z" in keys and "\\N|n" in keys


# --- undeclared loading -----------------------------------------------------------------


def test_all_text_load(spark, tmp_path, caplog):
    write(tmp_path / "orders.csv", " ID ,Amount\n007,10\n,\n")
    loaded = csv_tables.load_all_text(spark, str(tmp_path))
    assert list(loaded) == ["orders"]
    assert sorted(map(tuple, spark.table("orders").collect())) == [("", ""), ("007", "10")]
    (tmp_path / "none").mkdir()
    with caplog.at_level("WARNING"):
        assert csv_tables.load_all_text(spark, str(tmp_path / "none")) == {}
    assert "no CSV" in caplog.text
    write(tmp_path / "bad" / "1-table.csv", "a\n1\n")
    with pytest.raises(ValueError, match="1-table"):
        csv_tables.load_all_text(spark, str(tmp_path / "bad"))


def test_inferred_load(spark, tmp_path):
    write(tmp_path / "t.csv", "A,b,c\n1,1.5,x\n2,,y\n")
    schema = csv_tables.load_inferred(spark, str(tmp_path))["t"].schema
    assert [(f.name, family(f.dataType)) for f in schema.fields] == [("a", "integer"), ("b", "float"), ("c", "string")]


@pytest.mark.parametrize(
    "text, sep",
    [("a;b;c\n1,5;2;3\n", ";"), ("a\tb\n1\t2\n", "\t"), ("a|b\n", "|"), ("a,b;c\n", ","), ("nothing\n", ","), ("", ",")],
)
def test_separator(spark, tmp_path, text, sep):
    assert csv_tables.detect_delimiter(spark, write(tmp_path / "t.csv", text)) == sep


# --- normalisation ----------------------------------------------------------------------


def test_null_tokens_and_trim(spark):
    words = ["", " ", "NULL", "None", "na", "N/A", "?", "NaN", "nil", "n.a.", "ND", "#N/A"]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [("\t keep\xa0\n", 99), ("nap", 100)], "v string, i int")
    out = {r["i"]: r["v"] for r in normalise.unify_nulls_and_trim(df).collect()}
    assert [out[i] for i in range(len(words))] == [None] * len(words)
    assert (out[99], out[100]) == ("keep", "nap")


def converted(spark, columns: dict[str, list]):
    names = list(columns)
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    return normalise.normalise(df)


def test_a_date_column_is_read_in_one_order(spark):
    spellings = ["2024-03-05 06:07:08", "2024-03-05T06:07:08", "2024-03-05", "20240305", "5/3/2024", "05/03/2024 06:07:08", "5-3-2024", "05.03.2024"]
    values = spellings * 3 + ["12/25/2026", "31/02/2024"]
    out = converted(spark, {"seen": values})
    # The day comes first in 12 values, the month in 7; a date of the other order is not read the other way.
    assert out.converted == {"seen": "date"} and out.coerced_to_null == {"seen": 2}
    got = [r["seen"] for r in out.rows.collect()]
    assert {d.date() for d in got[:8]} == {dt.date(2024, 3, 5)}
    assert got[24] is None and got[25] is None
    assert out.orders == {"seen": ("dMy", "yMd")} and out.ambiguous == {}


def test_election_of_the_order(spark):
    n = 24
    days = [dt.date(2024, i % 12 + 1, (i * 7) % 28 + 1) for i in range(n)]
    low = [dt.date(2024, i % 12 + 1, i % 9 + 1) for i in range(n)]
    out = converted(
        spark,
        {
            "american": [f"{d:%m/%d/%Y}" for d in days],
            "european": [f"{d:%d/%m/%Y}" for d in days],
            "open": [f"{d:%m/%d/%Y}" for d in low],
            "mixed": [f"{d:%m/%d/%Y}" if i % 2 else f"{d:%d.%m.%Y}" for i, d in enumerate(days)],
            "clock": [f"{d:%m/%d/%Y} 01:02:03" if i % 2 else f"{d:%Y-%m-%d}" for i, d in enumerate(days)],
        },
    )
    assert out.orders["american"][0] == out.orders["clock"][0] == "Mdy" and out.orders["european"][0] == out.orders["open"][0] == "dMy"
    rows = out.rows.collect()
    for c in ("american", "european", "clock"):
        assert [r[c].date() for r in rows] == days and out.coerced_to_null[c] == 0
    # Read day first, as nothing speaks against it, and named.
    assert out.ambiguous.keys() == {"open"} and out.ambiguous["open"] == sum(d.day != d.month for d in low)
    assert "mixed" not in out.converted or out.coerced_to_null["mixed"] > 0


def test_custom_formats_are_elected_too(spark):
    days = [dt.date(2024, i % 12 + 1, i % 28 + 1) for i in range(30)]
    df = spark.createDataFrame([(f"{d:%Y|%d|%m}", f"{d:%Y|%m|%d}") for d in days], "a string, b string")
    out = normalise.infer_types(df, ["yyyy'|'MM'|'dd", "yyyy'|'dd'|'MM"])
    assert out.orders == {"a": ("ydM",), "b": ("yMd",)}
    assert [tuple(x.date() for x in r) for r in out.rows.collect()] == [(d, d) for d in days]


def test_a_side_in_doubt_follows_the_other(spark):
    days = [dt.date(2024, i % 12 + 1, i % 28 + 1) for i in range(30)]
    low = [d for d in days if d.day <= 12] * 3
    side = lambda values, pattern: spark.createDataFrame([(format(d, pattern),) for d in values], "seen string")
    both = normalise.normalise_pair(side(days, "%m/%d/%Y"), side(low, "%m/%d/%Y"))
    assert both.orders["seen"] == (("Mdy", "yMd"), ("Mdy", "yMd")) and both.ambiguous["seen"][0] == 0 < both.ambiguous["seen"][1]
    assert {r["seen"].date() for r in both.target.collect()} == set(low)
    # Each side is one program's writing: equal days in two spellings are equal.
    both = normalise.normalise_pair(side(days, "%m/%d/%Y"), side(days, "%d/%m/%Y"))
    assert both.orders["seen"] == (("Mdy", "yMd"), ("dMy", "yMd"))
    assert both.source.exceptAll(both.target).isEmpty()


def test_whole_numbers_are_not_rounded(spark):
    rows = [(str(2**53 + i), f"{i}.5", "9" * 19) for i in range(4)]
    out = normalise.infer_types(spark.createDataFrame(rows, "a string, b string, c string"))
    assert [f.dataType.simpleString() for f in out.rows.schema] == ["bigint", "double", "double"]
    assert sorted(r["a"] for r in out.rows.collect()) == [2**53 + i for i in range(4)]


def test_date_rules(spark):
    n = 20
    days = [f"2024-01-{i + 1:02d}" for i in range(n)]
    out = converted(
        spark,
        {
            "mixed": days[:15] + ["soon"] * 5,
            "mostly": days[:16] + ["soon"] * 4,
            "start_date": ["soon"] * n,
            "birth": [str(1990 + i) for i in range(n)],
            "fiscal_year": ["12"] * n,
        },
    )
    assert out.converted == {"mostly": "date", "start_date": "date"}
    assert out.coerced_to_null == {"mostly": 4, "start_date": 20}
    assert converted(spark, {"start_date": days[:19]}).converted == {}


def test_number_rule(spark):
    out = converted(
        spark,
        {
            "half": ["1", "2", "x", "y"],
            "less": ["1", "x", "y", "z"],
            "gaps": ["1.5", None, None, None],
            "void": [None, "", "?", "nd"],
            "suffix": ["1d", "2f", "3", "x"],
            "forms": ["+1", "-.5", "1e3", "7."],
        },
    )
    assert out.converted == {"half": "number", "gaps": "number", "forms": "number"}
    assert out.coerced_to_null["half"] == 2
    assert [r["forms"] for r in out.rows.collect()] == [1.0, -0.5, 1000.0, 7.0]


def test_caller_may_replace_the_date_formats(spark):
    df = spark.createDataFrame([("03~2024~05",)] * 20, "d string")
    out = normalise.infer_types(df, ["MM'~'yyyy'~'dd"])
    assert out.converted == {"d": "date"} and out.rows.first()["d"] == dt.datetime(2024, 3, 5)


def test_whole_numbers_with_blanks_stay_whole(spark, tmp_path):
    from concordat.plans.validate import load_delimited

    df = load_delimited(spark, write(tmp_path / "t.csv", "id,qty\n1,5\n2,\n3,7\n"))
    assert family(df.schema["qty"].dataType) == "integer" and df.where("qty IS NULL").count() == 1


def test_no_warning_for_known_types(spark, tmp_path):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        load_schema(spark, write(tmp_path / "t.csv", 'column_name,type\na,"NUMERIC(10,2)"\nb,clob\n'))
