"""Writing tables: CSV, Parquet or catalog, extra copies, preview, published runs."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.session import materialise
from concordat.sinks.staging import Staged, job_of, recover
from concordat.sources.paths import exists, qualified

log = logging.getLogger(__name__)


def save_csv(df: DataFrame, output_dir: str, name: str) -> str:
    """``<output_dir>/<name>.csv``: a directory of part files with headers, replaced whole."""
    path = f"{str(output_dir).rstrip('/')}/{name}.csv"
    replace_path(df.sparkSession, path, lambda at: write_csv(df, at))
    return path


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(str(path))


def replace_path(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write beside ``path``, then swap: a write that fails, or reads what it replaces, leaves or finds the old table whole."""
    final = qualified(spark, str(path))
    folder, job = final.rpartition("/")[0], job_of([final])
    recover(spark, folder, job)
    with Staged(spark, folder, job) as staged:
        write(staged.place(str(path)))
        staged.commit()


def persist_table(df: DataFrame, name: str | None = None, path: str | None = None) -> None:
    """Replace a catalog table (``name``) or a Parquet directory (``path``); never append.

    The new rows are stored beside the old ones first, so a failure leaves the old table in place.
    """
    if path:
        replace_path(df.sparkSession, path, lambda at: df.write.parquet(at))
    if name:
        _replace_table(df, name)


def _replace_table(df: DataFrame, name: str) -> None:
    spark, mark = df.sparkSession, uuid.uuid4().hex
    parts = name.split(".")
    beside, old = (".".join([*parts[:-1], f"{parts[-1]}__{kind}_{mark}"]) for kind in ("new", "old"))
    full = lambda n: ".".join(f"`{p}`" for p in n.split("."))
    try:
        df.write.mode("error").format("parquet").saveAsTable(beside)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {full(beside)}")
        raise
    stood = spark.catalog.tableExists(name)
    if stood:
        spark.sql(f"ALTER TABLE {full(name)} RENAME TO {full(old)}")
    try:
        spark.sql(f"ALTER TABLE {full(beside)} RENAME TO {full(name)}")
    except Exception:
        if stood:
            spark.sql(f"ALTER TABLE {full(old)} RENAME TO {full(name)}")
        raise
    if stood:
        spark.sql(f"DROP TABLE {full(old)}")


def save_outputs(
    tables: dict[str, DataFrame],
    output_dir: str,
    extra_csv_paths: dict[str, str] | None = None,
    persist: bool = True,
    table_dir: str | None = None,
    job: str | None = None,
) -> dict[str, list[str]]:
    """CSV per table, extra CSV copies, and (``persist``) a table in Parquet; all are replaced together, or none.

    The Parquet copy is written first and the CSVs are written from it, so the plan of an
    output runs once however many copies are asked for. With ``job`` the ledger of ``output_dir`` records the paths as its own,
    and what its last run made and this one does not goes.
    """
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    folder = qualified(spark, str(output_dir))
    written: dict[str, list[str]] = {}
    writer = job or job_of([folder, *tables])
    recover(spark, folder, writer)
    with Staged(spark, folder, writer) as staged:
        for name, df in tables.items():
            extra = (extra_csv_paths or {}).get(name)
            if persist:
                stored = staged.place(f"{str(table_dir or output_dir).rstrip('/')}/{name}.parquet")
                df.write.parquet(stored)
                df = spark.read.schema(df.schema).parquet(stored)
            elif extra:
                df = materialise(df, "output")
            written[name] = [f"{str(output_dir).rstrip('/')}/{name}.csv", *([str(extra)] if extra else [])]
            for path in written[name]:
                write_csv(df, staged.place(path))
        staged.commit(ledger=job is not None)
    return written


@dataclass(frozen=True)
class Preview:
    rows: int
    head: list
    more: int


def preview(df: DataFrame, max_rows: int = 50) -> Preview:
    rows = df.count()
    return Preview(rows, df.limit(max_rows).collect(), max(rows - max_rows, 0))


def write_fixture(
    spark: SparkSession, rows: list[dict[str, Any]], out: str, producer: str, table: str, suffix: str
) -> str | None:
    """Hand-made rows to ``<out>/<producer>/<table>/<suffix>.csv``; nothing for no rows."""
    if not rows:
        log.warning("no rows for %s/%s, nothing written", table, suffix)
        return None
    names = list(rows[0])
    schema = ", ".join(f"`{n}` string" for n in names)
    text = [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows]
    return save_csv(spark.createDataFrame(text, schema).coalesce(1), f"{str(out).rstrip('/')}/{producer}/{table}", suffix)


MANIFEST = "_published"


def publish_run(spark: SparkSession, tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """All outputs of a run become visible together.

    Each attempt writes to folders of its own, and one row per table in the manifest, in a single small file
    committed last, makes them the current ones. A reader never sees half a run; a failed run, also one of a
    ``run_id`` published before, leaves what was there in place.
    """
    root = str(root).rstrip("/")
    attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{root}/{name}/run={run_id}/{attempt}")
    manifest = spark.createDataFrame([(run_id, name, attempt) for name in tables], _MANIFEST_SCHEMA)
    manifest.coalesce(1).write.mode("append").json(f"{root}/{MANIFEST}")


_MANIFEST_SCHEMA = "run_id string, table_name string, attempt string"


def read_published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table as of the newest attempt in the manifest that wrote it; attempts are named by their time."""
    root = str(root).rstrip("/")
    if not exists(spark, f"{root}/{MANIFEST}"):
        raise FileNotFoundError(f"nothing has been published under {root}")
    runs = spark.read.schema(_MANIFEST_SCHEMA).json(f"{root}/{MANIFEST}")
    newest = F.max(F.struct("attempt", "run_id")).alias("newest")
    row = runs.where(F.col("table_name") == table).agg(newest).first()["newest"]
    if row is None:
        raise FileNotFoundError(f"table '{table}' was never published under {root}")
    return spark.read.parquet(f"{root}/{table}/run={row['run_id']}/{row['attempt']}")
