"""A transformation as named SQL steps, and the load-transform-save pipeline around it."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from concordat.functions.sql import quoted
from concordat.sinks.reports import write_step_error
from concordat.sinks.staging import Ledger, job_of, recover
from concordat.sinks.tables import Preview, preview, publish_run, save_outputs
from concordat.sources.csv_tables import load_all_text, load_declared
from concordat.sources.paths import exists, list_csv, qualified, require_safe_name
from concordat.sources.schema_files import load_schemas

log = logging.getLogger(__name__)


def run_steps(
    spark: SparkSession,
    steps: Iterable[tuple[str, str]],
    outputs: list[str] | None = None,
    error_log: str | None = None,
) -> dict[str, DataFrame]:
    """Run (name, SQL) steps in order; each result is a view the later steps can read.

    A name used twice keeps its last result. Results stay lazy, so Catalyst plans a chain of
    steps as one query and nothing is stored between them. ``outputs`` names the tables
    asked for, all of them by default. A failing step is logged with its statement and
    raised; no steps is an error.
    """
    results: dict[str, DataFrame] = {}
    for name, sql in steps:
        require_safe_name(name)
        try:
            df = spark.sql(sql)
        except Exception as error:
            log.error("step '%s' failed: %s\n%s", name, error, sql)
            if error_log:
                write_step_error(spark, error_log, name, sql, error)
            raise
        df.createOrReplaceTempView(name)
        results.pop(name, None)
        results[name] = df
    if not results:
        raise RuntimeError("there are no steps to run")
    unknown = sorted(set(outputs or []) - results.keys())
    if unknown:
        raise KeyError(f"no step is named {unknown}")
    return {name: df for name, df in results.items() if outputs is None or name in outputs}


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    return run_steps(spark, [("result", sql)])["result"]


def _finals(target: str, made: list[str], extra: dict[str, str], persist: bool) -> list[str]:
    """Where the outputs of a run will stand."""
    kinds = ("csv", "parquet") if persist else ("csv",)
    return [*(f"{target}/{n}.{kind}" for n in made for kind in kinds), *(str(extra[n]) for n in made if n in extra)]


def owning_job(spark: SparkSession, target: str, finals: list[str], job: str | None) -> str:
    """The job that made what a run is going to make again; a new one if nobody did.

    A run that would write over the outputs of another job, or of several, has to say which it is.
    """
    owners = Ledger(spark, target).owners()
    jobs = {owners[p] for p in (qualified(spark, f) for f in finals) if p in owners}
    if jobs - {job} if job else len(jobs) > 1:
        raise ValueError(f"these outputs would be written over those of other jobs ({sorted(jobs)}), choose an output_dir")
    return job or next(iter(jobs), None) or job_of(finals)


def _refuse_inputs(spark: SparkSession, inputs: dict[str, str], finals: list[str]) -> None:
    taken = {qualified(spark, path) for path in inputs.values()}
    if clash := sorted(f for f in finals if qualified(spark, f) in taken):
        raise ValueError(f"these outputs would be written over inputs, choose an output_dir: {clash}")


@contextmanager
def own_views(spark: SparkSession) -> Iterator[set[str]]:
    """Views registered inside the block go at its end, and those that stood under their names come back.

    The block adds the names it is about to register to the set it gets.
    """
    standing = {t.name: spark.table(quoted(t.name)) for t in spark.catalog.listTables() if t.isTemporary}
    names: set[str] = set()
    try:
        yield names
    finally:
        for name in names:
            spark.catalog.dropTempView(name)
            if name in standing:
                standing[name].createOrReplaceTempView(name)


@dataclass
class Execution:
    schemas: dict[str, T.StructType]
    outputs: dict[str, DataFrame]
    previews: dict[str, Preview] = field(default_factory=dict)
    written: dict[str, list[str]] = field(default_factory=dict)


def execute(
    spark: SparkSession,
    steps: Iterable[tuple[str, str]],
    data_dir: str,
    ddl_dir: str | None = None,
    output_dir: str | None = None,
    outputs: list[str] | None = None,
    persist: bool = True,
    show: bool = True,
    extra_csv_paths: dict[str, str] | None = None,
    publish_as: str | None = None,
    error_log: str | None = None,
    job: str | None = None,
) -> Execution:
    """Load the inputs, run the steps, save the outputs.

    With ``ddl_dir`` inputs follow their declared schemas; without it every CSV of
    ``data_dir`` is loaded as text. What this job made there before is no input; what another job made is. Outputs may not be
    written over inputs or other jobs' outputs.

    Outputs are written aside and take their places together once all are there; then what the last run of this job made and this
    one does not goes. A failed run leaves everything as it was. A run belongs to the job whose outputs it makes again, or to
    ``job``. With ``publish_as`` (a run id) the outputs are also kept by run. The steps see the inputs and each other, not views that
    an earlier run left in the session, and leave none.
    """
    steps, extra = list(steps), extra_csv_paths or {}
    target = qualified(spark, str(output_dir or data_dir))
    finals = _finals(target, sorted({name for name, _ in steps} if outputs is None else set(outputs)), extra, persist)
    job = owning_job(spark, target, finals, job)
    recover(spark, target, job)
    own = Ledger(spark, target).paths(job)
    there = list_csv(spark, data_dir) if exists(spark, data_dir) else []
    inputs = {table: path for table, path in there if qualified(spark, path) not in own}
    _refuse_inputs(spark, inputs, finals)
    schemas = load_schemas(spark, ddl_dir) if ddl_dir else {}
    with own_views(spark) as views:
        views |= {name for name, _ in steps}
        for name in views:
            spark.catalog.dropTempView(name)
        if schemas:
            for table, load in load_declared(spark, data_dir, schemas).items():
                views.add(table)
                load.rows.createOrReplaceTempView(table)
        else:
            views |= set(inputs)
            schemas = {table: df.schema for table, df in load_all_text(spark, data_dir, only=set(inputs)).items()}
        results = run_steps(spark, steps, outputs, error_log)
    written = save_outputs(results, target, extra, persist, job=job)
    if persist:
        results = {n: spark.read.schema(df.schema).parquet(f"{target}/{n}.parquet") for n, df in results.items()}
    if publish_as:
        publish_run(spark, results, f"{target}/published", publish_as)
    previews = {n: preview(df) for n, df in results.items()} if show else {}
    return Execution(schemas, results, previews, written)
