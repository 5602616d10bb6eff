"""Run a query and its SQL twin and compare them as bags of rows, columns by name."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        # repr of 0.0 and -0.0 differ, the numbers do not.
        return repr(float(v) + 0.0)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return str(v)


def bag(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    mine = spark_df.collect()
    cur = con.execute(sql)
    names, theirs = [d[0] for d in cur.description], cur.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}"
    a, b = bag(spark_df.columns, mine), bag(names, theirs)
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
        return f"{len(only_a)} rows differ, e.g. {only_a[:3]} vs {only_b[:3]}"
    return None
