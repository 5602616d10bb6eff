"""Table schemas declared in small CSV files (column_name,type[,nullable,primary_key])."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.types import parse_type_token
from concordat.sources.csv_tables import read_text_columns
from concordat.sources.paths import exists, list_csv

REQUIRED = ("column_name", "type")
OPTIONAL = {"nullable": True, "primary_key": False}
# Spellings of a flag.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")


def _read_declaration(spark: SparkSession, path: str, table: str) -> DataFrame:
    raw = read_text_columns(spark, path)
    lacking = sorted(set(REQUIRED) - set(raw.columns))
    if lacking:
        raise ValueError(f"schema file '{path}' lacks the columns {lacking}; it needs {sorted(REQUIRED)}")
    kept = [c for c in (*REQUIRED, *OPTIONAL) if c in raw.columns]
    return raw.select(
        F.lit(table).alias("table_name"),
        F.monotonically_increasing_id().alias("position"),
        *[F.trim(c).alias(c) for c in kept],
    )


def _flag(word: str | None, default: bool) -> bool:
    word = (word or "").lower()
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else default


def _to_struct(rows: list) -> T.StructType:
    fields = []
    for row in sorted(rows, key=lambda r: r["position"]):
        if not row["column_name"]:
            raise ValueError(f"table '{row['table_name']}': a row of the schema file has no column_name")
        flags = {k: _flag(row[k] if k in row else None, default) for k, default in OPTIONAL.items()}
        dtype, fam = parse_type_token(row["type"] or "", row["column_name"])
        # Blanks must load before they can be reported, so nullability lives in the
        # metadata and is enforced by constraints.constraint_violations.
        meta = {"declared_type": row["type"], "family": fam, **flags}
        fields.append(T.StructField(row["column_name"], dtype, True, meta))
    return T.StructType(fields)


def load_schema(spark: SparkSession, path: str, table: str = "output") -> T.StructType:
    """One declared table. Raises FileNotFoundError or ValueError on a bad declaration."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no schema file: {path}")
    return _to_struct(_read_declaration(spark, str(path), table).collect())


def load_schemas(spark: SparkSession, directory: str) -> dict[str, T.StructType]:
    """Every ``*.csv`` of a directory as one table named by the file, in name order."""
    files = list_csv(spark, directory)
    if not files:
        raise FileNotFoundError(f"no schema files (*.csv) in {directory}")
    # Files differ in their optional columns, hence one read each and a union by name.
    declared = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [_read_declaration(spark, path, table) for table, path in files],
    )
    by_table: dict[str, list] = {table: [] for table, _ in files}
    for row in declared.collect():
        by_table[row["table_name"]].append(row.asDict())
    return {table: _to_struct(rows) for table, rows in by_table.items()}


def primary_key(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if f.metadata.get("primary_key")]


def required_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not f.metadata.get("nullable", True)]


def comparison_hints(schema: T.StructType) -> dict:
    """What a schema can tell a comparison: its key and the family of each column."""
    return {
        "primary_key": primary_key(schema),
        "column_types": {f.name: f.metadata.get("family") for f in schema.fields},
    }
