"""Many comparisons in one run: all pairs, two baselines in order, completeness."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, as_completed
from contextvars import copy_context
from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.config import PASSED, Comparison
from concordat.plans.report import checks_frame, overall_status
from concordat.plans.run_ledger import RunLedger, content_key
from concordat.plans.validate import Report, failed_to_load, validate
from concordat.sources.paths import list_csv


Table = DataFrame | str | None


def pair_up(outputs: dict[str, Table], expected: dict[str, Table]) -> list[tuple[str, Table, Table]]:
    """(name, output, expected) of every table that either side has, None where one lacks it."""
    return [(name, outputs.get(name), expected.get(name)) for name in sorted(outputs.keys() | expected.keys())]


def discover_pairs(spark: SparkSession, output_dir: str, expected_dir: str) -> list[tuple[str, Table, Table]]:
    """The CSV tables of two directories, paired by name."""
    return pair_up(dict(list_csv(spark, output_dir)), dict(list_csv(spark, expected_dir)))


@dataclass
class MultiReport:
    reports: list[Report]
    checks: DataFrame
    # Comparisons that an earlier, interrupted run had finished.
    resumed: list[str] = field(default_factory=list)

    @property
    def success(self) -> bool:
        """No pairs at all is a failure: nothing was shown to be equal."""
        return bool(self.reports) and all(r.passed for r in self.reports)


def _compare(spark: SparkSession, cfg: Comparison, name: str, output: Table, expected: Table) -> Report:
    own = replace(cfg, name=name)
    if output is None or expected is None:
        side = "output" if output is None else "expected"
        return failed_to_load(spark, own, f"missing_{side}", f"table '{name}' has no {side} table")
    return validate(expected, output, own, spark)


def _in_pools(spark: SparkSession, work: dict[str, Callable[[], Report]], at_once: int, finished: Callable[[str, Report], None]) -> dict[str, Report]:
    """Run independent comparisons side by side, each in a scheduler pool of its own (under ``spark.scheduler.mode=FAIR`` they share
    the cluster evenly); ``finished`` is called for each as it ends."""

    def run(name: str, job: Callable[[], Report]) -> Report:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"compare-{name}")
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    done: dict[str, Report] = {}
    with ThreadPoolExecutor(max(1, at_once), thread_name_prefix="compare") as pool:
        running = {pool.submit(copy_context().run, run, name, job): name for name, job in work.items()}
        try:
            for future in as_completed(running):
                done[running[future]] = future.result()
                finished(running[future], done[running[future]])
        except BaseException:
            for future in running:
                future.cancel()
            raise
    return {name: done[name] for name in work}


def compare_many(
    spark: SparkSession,
    pairs: Iterable[tuple[str, Table, Table]],
    config: Comparison | None = None,
    report_path: str | None = None,
    at_once: int = 4,
) -> MultiReport:
    """Validate (name, output, expected), ``at_once`` side by side; the expected table is the source.

    A table that one side lacks is a failed comparison, with a row of its own. With ``report_path`` the rows of a comparison are written
    as it ends, and a ledger beside them says which were. A run that is begun again under the ``run_id`` of one that broke off
    takes the results of those whose inputs and settings are the same (``run_ledger.content_key``) and validates the others.
    """
    cfg = config or Comparison()
    cfg = replace(cfg, run=cfg.run_name())
    ledger = RunLedger(spark, report_path, cfg.run) if report_path else None
    reports: dict[str, Report] = {}
    work, keys, resumed = {}, {}, []
    for name, output, expected in pairs:
        keys[name] = content_key(spark, replace(cfg, name=name), output, expected) if ledger else None
        reports[name] = ledger.finished(name, keys[name], cfg) if ledger else None
        if reports[name] is not None:
            resumed.append(name)
        else:
            work[name] = partial(_compare, spark, cfg, name, output, expected)
    reports |= _in_pools(spark, work, at_once, lambda name, r: ledger.record(name, keys[name], r) if ledger else None)
    rows = [row for r in reports.values() for row in r.rows()]
    return MultiReport(list(reports.values()), checks_frame(spark, rows), resumed)


PHASES = "phase string, ordinal int, success boolean"


def two_phase_verdict(phases: DataFrame) -> DataFrame:
    """One row (status, winning_phase, reported_phase) from (phase, ordinal, success).

    Either baseline is enough; the later, stricter one is preferred when it passes. With no
    success the last phase is the one reported.
    """
    picked = phases.agg(
        F.max_by(F.when(F.col("success"), F.col("phase")), F.when(F.col("success"), F.col("ordinal"))).alias("winner"),
        F.max_by("phase", "ordinal").alias("last"),
    )
    return picked.select(
        F.when(F.col("winner").isNotNull(), "success").otherwise("failure").alias("status"),
        F.col("winner").alias("winning_phase"),
        F.coalesce("winner", "last").alias("reported_phase"),
    )


def phases_from_checks(checks: DataFrame, order: list[str], required: list[str] | None = None) -> DataFrame:
    """(phase, ordinal, success) where a phase is a run_id and succeeds if every comparison
    of it passed; a phase without check rows, or without those of a ``required`` table, did not succeed."""
    statuses, needed = overall_status(checks), set(required or [])
    passed = F.bool_and(F.col("status") == PASSED)
    if needed:
        passed &= F.count_distinct(F.when(F.col("comparison").isin(*needed), F.col("comparison"))) == len(needed)
    per_run = statuses.groupBy("run_id").agg(passed.alias("ok"))
    listed = checks.sparkSession.createDataFrame(list(zip(order, range(1, len(order) + 1))), "phase string, ordinal int")
    joined = listed.join(per_run, listed["phase"] == per_run["run_id"], "left")
    return joined.select("phase", "ordinal", F.coalesce("ok", F.lit(False)).alias("success"))


@dataclass
class TwoPhaseResult:
    status: str
    winning_phase: str | None
    reported_phase: str
    reports: dict[str, MultiReport]


def validate_two_phases(
    spark: SparkSession,
    outputs: dict[str, DataFrame],
    baselines: dict[str, dict[str, DataFrame]],
    config: Comparison | None = None,
    at_once: int = 4,
) -> TwoPhaseResult:
    """Compare the outputs with each baseline, all comparisons side by side; the order of the baselines decides."""
    work = {}
    for phase, expected in baselines.items():
        cfg = replace(config or Comparison(), run=phase)
        work |= {(phase, name): partial(_compare, spark, cfg, name, o, e) for name, o, e in pair_up(outputs, expected)}
    made = _in_pools(spark, work, at_once, lambda *_: None)
    reports = {}
    for phase in baselines:
        own = [r for (p, _), r in made.items() if p == phase]
        reports[phase] = MultiReport(own, checks_frame(spark, [row for r in own for row in r.rows()]))
    rows = [(phase, i, r.success) for i, (phase, r) in enumerate(reports.items(), 1)]
    v = two_phase_verdict(spark.createDataFrame(rows, PHASES)).first()
    return TwoPhaseResult(v["status"], v["winning_phase"], v["reported_phase"], reports)


def completeness(required: list[str], parts: dict[str, dict[str, DataFrame]], spark: SparkSession) -> DataFrame:
    """(table_name, part, problem) for every gap in a test set; no rows means complete.

    ``parts`` maps a part ("schema", "data", "expected", ...) to its tables. A required
    table must exist in every part and have rows there.
    """
    needed = spark.createDataFrame([(t, p) for p in parts for t in required], "table_name string, part string")
    # One row is enough to know that a table is not empty.
    counts = [
        df.limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), F.lit(p).alias("part"), "n")
        for p, tables in parts.items()
        for t, df in tables.items()
    ]
    empty = spark.createDataFrame([], "table_name string, part string, n bigint")
    found = reduce(DataFrame.unionAll, counts, empty)
    problem = F.when(F.col("n").isNull(), "missing").otherwise("empty")
    return (
        needed.join(found, ["table_name", "part"], "left")
        .where("n is null or n = 0")
        .select("table_name", "part", problem.alias("problem"))
    )


def is_complete(required: list[str], parts: dict[str, dict[str, DataFrame]], spark: SparkSession) -> bool:
    return completeness(required, parts, spark).isEmpty()
