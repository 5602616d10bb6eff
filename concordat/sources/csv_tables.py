"""CSV in: declared schemas, all-text tables, inferred types, rejects and violations."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.cells import strip_text, to_datetime, to_number
from concordat.functions.sql import literal, quoted
from concordat.sources.paths import exists, list_csv, require_safe_name
from concordat.sources.records import records

log = logging.getLogger(__name__)


def _reader(spark: SparkSession, sep: str, encoding: str, multiline: bool):
    # A quote inside a quoted field is doubled, as spreadsheets and databases write it.
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )


#: Column for the text of a record that does not fit; no header can have a line break, so no column is called so.
_CORRUPT = "corrupt\nrecord"


def header_of(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    return _reader(spark, sep, encoding, False).csv(str(path)).columns


def _cells(record: str, sep: str) -> str:
    """How many cells a record has: separators outside quotes, and one."""
    bare = f"regexp_replace({record}, {literal('"([^"]|"")*"')}, '')"
    return f"(length({bare}) - length(replace({bare}, {literal(sep)}, '')) + 1)"


def _located(spark: SparkSession, path: str, names: list[str], sep: str, encoding: str, multiline: bool) -> DataFrame:
    """Every record parsed, with its place and, if it does not have a cell for each column, the reason.

    Columns of the table come first, under their own names; what is added has a line break in its name.
    """
    found = records(spark, path, multiline, encoding)
    kinds = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _CORRUPT)])
    options = {"sep": sep, "quote": '"', "escape": '"', "columnNameOfCorruptRecord": _CORRUPT, "maxCharsPerColumn": "-1", "columnPruning": "false"}
    cells = F.from_csv("record", kinds.toDDL(), options)
    parsed = found.select(F.col("file").alias("file\n"), F.col("byte_offset").alias("byte_offset\n"), F.col("record").alias("record\n"), cells.alias("cells\n"))
    own = [f"coalesce({quoted('cells\n')}.{quoted(n)}, '') AS {quoted(n)}" for n in names]
    count, n = _cells(quoted("record\n"), sep), len(names)
    corrupt = f"{quoted('cells\n')}.{quoted(_CORRUPT)} IS NOT NULL"
    size = f"CASE WHEN {count} > {n} THEN 'too wide: ' WHEN {count} < {n} THEN 'too narrow: ' ELSE 'cannot be parsed: ' END"
    reasons = [(corrupt, f"concat({size}, {count}, ' cells for {n} columns')")]
    if multiline:
        # An open quote swallows what follows; a carriage return outside quotes would end the record for the parser.
        odd = f"length(replace({quoted('record\n')}, {literal('"')}, '')) % 2 <> length({quoted('record\n')}) % 2"
        bare = f"regexp_replace({quoted('record\n')}, {literal('"([^"]|"")*"')}, '')"
        reasons = [(odd, "'a quote that is not closed'"), (f"contains({bare}, {literal(chr(13))})", "'a line end inside the record'"), *reasons]
    why = f"CASE {' '.join(f'WHEN {condition} THEN {reason}' for condition, reason in reasons)} END"
    return parsed.selectExpr(*own, quoted("file\n"), quoted("byte_offset\n"), quoted("record\n"), f"{why} AS {quoted('reason\n')}")


def _fitting(spark: SparkSession, path: str, names: list[str], sep: str, encoding: str, strict: bool, kinds: T.StructType | None = None) -> DataFrame:
    """The rows that have a cell for each column, by Spark's own reader; others raise if ``strict``, else they are left out."""
    fields = list((kinds or T.StructType([T.StructField(n, T.StringType()) for n in names])).fields)
    schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    raw = _reader(spark, sep, encoding, False).schema(schema).option("columnNameOfCorruptRecord", _CORRUPT).option("columnPruning", False).csv(str(path))
    bad, first = quoted(_CORRUPT), quoted(fields[0].name)
    if not strict:
        # The reader refuses a filter on its own column alone.
        return raw.where(f"{bad} IS NULL AND ({first} IS NULL OR {first} IS NOT NULL)").selectExpr(*[quoted(f.name) for f in fields])
    complaint = f"concat({literal(f'a record does not have {len(fields)} cells, as the header has: ')}, {bad}, {literal(' in ')}, _metadata.file_path)"
    fits = f"CASE WHEN {bad} IS NULL THEN {first} IS NULL OR {first} IS NOT NULL ELSE CAST(raise_error({complaint}) AS boolean) END"
    return raw.where(fits).selectExpr(*[quoted(f.name) for f in fields])


def read_text_columns(
    spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", multiline: bool = False, strict: bool = True
) -> DataFrame:
    """Every column as text, headers trimmed and lower-cased, blanks kept as ''.

    A record with more or fewer cells than the header raises when it is read; with ``strict`` off it is left out, for callers
    that ask ``misfits`` for it. ``multiline`` is for files with line breaks inside quoted fields; they are split like others.
    """
    raw_names = header_of(spark, path, sep, encoding)
    names = [c.strip().lower() for c in raw_names]
    if multiline:
        found = _located(spark, path, raw_names, sep, encoding, True)
        why, place = quoted("reason\n"), f"concat({quoted('file\n')}, ' at byte ', {quoted('byte_offset\n')})"
        complaint = f"CAST(raise_error(concat({why}, ' in ', {place})) AS boolean)"
        raw = found.where(f"CASE WHEN {why} IS NULL THEN true ELSE {complaint if strict else 'false'} END").select(*map(quoted, raw_names))
    else:
        raw = _fitting(spark, path, raw_names, sep, encoding, strict)
    return raw.toDF(*names).selectExpr(*[f"coalesce({quoted(c)}, '') AS {quoted(c)}" for c in names])


def misfits(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", multiline: bool = False) -> DataFrame:
    """(file, byte_offset, record, reason) of the records that do not have a cell for each column of the header."""
    found = _located(spark, path, header_of(spark, path, sep, encoding), sep, encoding, multiline).where(f"{quoted('reason\n')} IS NOT NULL")
    return found.select(*[F.col(quoted(f"{n}\n")).alias(n) for n in ("file", "byte_offset", "record", "reason")])


def check_columns(actual: list[str], expected: list[str], filename: str) -> None:
    """Order is free, names are exact; one message reports both sides of a mismatch."""
    missing, extra = sorted(set(expected) - set(actual)), sorted(set(actual) - set(expected))
    if missing or extra:
        parts = [f"missing {missing}"] * bool(missing) + [f"unexpected {extra}"] * bool(extra)
        raise ValueError(f"columns of '{filename}' do not fit the declared schema: {', '.join(parts)}")


def typed(c: str, dtype: T.DataType) -> str:
    """Stripped text to the declared type (SQL text), null where it does not parse or is blank."""
    kind = dtype.simpleString()
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return f"CAST({to_datetime(c)} AS {kind})"
    if isinstance(dtype, T.BooleanType):
        return f"try_cast({c} AS boolean)"
    return to_number(c, kind)


@dataclass(frozen=True)
class TypedLoad:
    rows: DataFrame
    rejects: DataFrame | None


def enforce_types(raw: DataFrame, schema: T.StructType, mode: str = "failfast") -> TypedLoad:
    """Cast text columns to the declared types.

    ``failfast`` raises inside the task that meets a bad value, as a typed insert would.
    ``quarantine`` keeps good rows in ``rows`` and whole bad rows, with the offending
    columns named, in ``rejects``. Both are narrow: no shuffle. ``raw`` may have other columns than the
    schema's; they stand in the rejects.
    """
    metadata = {f.name: f.metadata for f in schema.fields}
    strict = {f.name: f.dataType for f in schema.fields if not isinstance(f.dataType, T.StringType)}
    # Stripped and parsed copies in projections of their own, so each happens once per cell.
    stripped = raw.selectExpr("*", *[f"{strip_text(quoted(n))} AS {quoted('__s_' + n)}" for n in strict])
    parsed = stripped.selectExpr("*", *[f"{typed(quoted('__s_' + n), t)} AS {quoted('__t_' + n)}" for n, t in strict.items()])
    bad = {n: f"({quoted('__s_' + n)} <> '' AND {quoted('__t_' + n)} IS NULL)" for n in strict}

    def described(df: DataFrame, values: dict[str, str]) -> DataFrame:
        chosen = df.selectExpr(*[f"{values.get(n, quoted(n))} AS {quoted(n)}" for n in schema.names])
        return chosen.select(*[F.col(quoted(n)).alias(n, metadata=metadata[n]) for n in schema.names])

    values = {n: quoted("__t_" + n) for n in strict}
    if mode == "failfast":
        for n, t in strict.items():
            kind = t.simpleString()
            complaint = f"concat({literal(f'column {n} is not {kind}: ')}, {quoted(n)})"
            values[n] = f"CASE WHEN {bad[n]} THEN CAST(raise_error({complaint}) AS {kind}) ELSE {values[n]} END"
        return TypedLoad(described(parsed, values), None)
    if mode != "quarantine":
        raise ValueError(f"mode is failfast or quarantine, not {mode!r}")
    names = ", ".join(f"CASE WHEN {bad[n]} THEN {literal(n)} END" for n in strict) or "CAST(NULL AS string)"
    flagged = parsed.selectExpr("*", f"array_compact(array({names})) AS bad_columns")
    rejects = flagged.where("size(bad_columns) > 0").selectExpr(*map(quoted, raw.columns), "bad_columns")
    return TypedLoad(described(flagged.where("size(bad_columns) = 0"), values), rejects)


def load_declared(
    spark: SparkSession,
    data_dir: str,
    schemas: dict[str, T.StructType],
    mode: str = "failfast",
    sep: str = ",",
    encoding: str = "UTF-8",
    multiline: bool = False,
) -> dict[str, TypedLoad]:
    """``<table>.csv`` for every declared table; files nobody declared are left alone.

    No cell is dropped. In failfast mode a record that is wider or narrower than the header raises. In quarantine it is
    a reject like one with a bad value: rejects have the text columns, ``bad_columns``, and the file, byte, whole record and reason.
    Only a caller that reads the rejects pays for the pass that finds places.
    """
    loads = {}
    for table, schema in schemas.items():
        path = f"{str(data_dir).rstrip('/')}/{table}.csv"
        if not exists(spark, path):
            raise FileNotFoundError(f"table '{table}' is declared but {path} does not exist")
        raw = read_text_columns(spark, path, sep, encoding, multiline, strict=mode != "quarantine")
        check_columns(raw.columns, schema.names, f"{table}.csv")
        load = enforce_types(raw.select(*[quoted(n) for n in schema.names]), schema, mode)
        if mode == "quarantine":
            names = [quoted(n) for n in schema.names]
            header = header_of(spark, path, sep, encoding)
            added = ("file", "byte_offset", "record", "reason")
            found = _located(spark, path, header, sep, encoding, multiline).toDF(*[c.strip().lower() for c in header], *[f"{n}\n" for n in added])
            places = [f"{quoted(n + '\n')} AS {quoted(n)}" for n in added]
            # A ragged record's cells are not trusted; the record itself is there.
            ragged = found.where(f"{quoted('reason\n')} IS NOT NULL").selectExpr(*[f"CAST(NULL AS string) AS {n}" for n in names], "CAST(array() AS array<string>) AS bad_columns", *places)
            mistyped = enforce_types(found.where(f"{quoted('reason\n')} IS NULL"), schema, mode).rejects
            told = "concat('not of the declared type: ', array_join(bad_columns, ', '))"
            mistyped = mistyped.selectExpr(*names, "bad_columns", *places[:3], f"{told} AS reason")
            load = TypedLoad(load.rows, ragged.unionAll(mistyped))
        loads[table] = load
    return loads


def load_all_text(spark: SparkSession, data_dir: str, only: set[str] | None = None, **options) -> dict[str, DataFrame]:
    """Every CSV of a directory (or those in ``only``) as an all-text table, registered as a view of its name."""
    files = [(table, path) for table, path in list_csv(spark, data_dir) if only is None or table in only]
    if not files:
        log.warning("no CSV files in %s", data_dir)
    tables = {require_safe_name(table): path for table, path in files}
    loaded = {table: read_text_columns(spark, path, **options) for table, path in tables.items()}
    for table, df in loaded.items():
        df.createOrReplaceTempView(table)
    return loaded


def load_inferred(spark: SparkSession, data_dir: str, sep: str = ",", encoding: str = "UTF-8") -> dict[str, DataFrame]:
    """Every CSV of a directory with types inferred by Spark."""
    out = {}
    for table, path in list_csv(spark, data_dir):
        df = read_inferred(spark, path, sep, encoding)
        out[require_safe_name(table)] = df.toDF(*[c.strip().lower() for c in df.columns])
    return out


def read_inferred(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Inference is one more pass over the file; headers stay as written. A record that does not fit the header raises."""
    kinds = _reader(spark, sep, encoding, False).option("inferSchema", True).csv(str(path)).schema
    return _fitting(spark, path, kinds.names, sep, encoding, True, kinds)


# Candidates in the order that settles a tie.
SEPARATORS = [",", ";", "\t", "|"]


def delimiter_profile(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """How often each candidate separator occurs in each table's text, over all lines: sums without a shuffle of text."""
    heads = []
    for table, path in paths.items():
        counts = [F.sum(F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit("")))) for sep in SEPARATORS]
        found = spark.read.text(path).agg(*[F.coalesce(n, F.lit(0)).alias(f"n{i}") for i, n in enumerate(counts)])
        heads.append(found.select(F.lit(table).alias("table_name"), "*"))
    counted = reduce(DataFrame.unionAll, heads)
    top = F.greatest(*[F.col(f"n{i}") for i in range(len(SEPARATORS))])
    pick = F.coalesce(*[F.when(F.col(f"n{i}") == top, F.lit(sep)) for i, sep in enumerate(SEPARATORS)])
    return counted.select(
        "table_name",
        F.col("n0").alias("commas"),
        F.col("n1").alias("semicolons"),
        F.col("n2").alias("tabs"),
        F.col("n3").alias("pipes"),
        pick.alias("delimiter"),
    )


def detect_delimiter(spark: SparkSession, path: str) -> str:
    return delimiter_profile(spark, {"t": str(path)}).first()["delimiter"]
