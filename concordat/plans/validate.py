"""The whole comparison of two tables."""

from __future__ import annotations

import datetime as dt
import json
import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from concordat.config import BUSINESS, DATA_LEVEL, FAILED, LOAD, PASSED, SKIPPED, STATISTICAL, STRUCTURAL, Comparison
from concordat.functions.sql import quoted
from concordat.operators import keyed_diff, totals
from concordat.operators.normalise import normalise_pair
from concordat.operators.pairing import Pair, align
from concordat.plans import business, data_level, statistics, structural
from concordat.plans.facts import Facts, gather
from concordat.plans.jobs import Jobs
from concordat.plans.report import Check, as_rows, checks_frame, verdict
from concordat.session import materialise
from concordat.sinks.reports import write_checks, write_headers
from concordat.sources.csv_tables import detect_delimiter, read_inferred, read_text_columns


@dataclass
class Report:
    spark: SparkSession
    config: Comparison
    run_id: str
    layers: dict[str, list[Check]]
    duration_ms: float = 0.0
    load_error: str | None = None
    pair: Pair | None = None
    started_at: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))

    def layer_status(self, layer: str) -> str:
        return FAILED if any(c.status == FAILED for c in self.layers[layer]) else PASSED

    @property
    def overall_status(self) -> str:
        """Nothing checked is nothing shown to be equal."""
        return FAILED if not self.layers or any(self.layer_status(x) == FAILED for x in self.layers) else PASSED

    @property
    def passed(self) -> bool:
        return self.overall_status == PASSED

    @property
    def check_rows(self) -> list[Check]:
        return [c for checks in self.layers.values() for c in checks]

    def check(self, name: str) -> Check:
        return next(c for c in self.check_rows if c.name == name)

    def rows(self) -> list[tuple]:
        return as_rows(self.check_rows, self.config, self.run_id)

    @cached_property
    def checks(self) -> DataFrame:
        return checks_frame(self.spark, self.rows())

    @property
    def summary(self) -> dict:
        rows = self.check_rows
        count = lambda status: sum(c.status == status for c in rows)
        ran = max(len(rows) - count(SKIPPED), 1)
        return {
            "total_checks": len(rows),
            "passed": count(PASSED),
            "failed": count(FAILED),
            "skipped": count(SKIPPED),
            "pass_rate": round(count(PASSED) / ran, 4),
            "equivalent": self.passed,
            "layer_statuses": {layer: self.layer_status(layer) for layer in self.layers},
        }

    def _compared(self) -> Pair:
        if self.pair is None:
            raise RuntimeError("the tables were not brought side by side, see the failed checks of the first layers")
        return self.pair

    def row_diff(self) -> DataFrame:
        """Every differing key, complete and lazy (the check itself shows a sample)."""
        return keyed_diff.row_diff(self._compared(), self.config.key)

    def group_differences(self) -> DataFrame:
        """Every group whose sums differ, complete and lazy (the check itself shows a sample)."""
        pair, cfg = self._compared(), self.config
        known = [c for c in cfg.totals.of if c in pair.columns]
        return totals.group_consistency(pair, cfg.totals.within, known, cfg.tolerances.others.absolute).where("NOT agrees")

    def cell_diff(self) -> DataFrame:
        """Every differing cell under the keys both sides have, complete and lazy."""
        key = self.config.key
        changed = self.row_diff().where(f"difference = '{keyed_diff.CHANGED}'").select(*map(quoted, key))
        return keyed_diff.cell_diff(self._compared(), key, changed)

    def header(self) -> tuple:
        """What a reader of the saved checks has to know, in the order of ``sinks.reports.HEADER``."""
        cfg = self.config
        return (self.run_id, cfg.name, cfg.sides[0], cfg.sides[1], self.started_at, float(self.duration_ms),
                self.overall_status, self.load_error, json.dumps(self.summary))

    def save(self, path: str) -> None:
        """Check rows to ``path``, the header of the run beside them."""
        write_checks(self.checks, path)
        write_headers(self.spark, [self.header()], path)


def load_delimited(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with its separator found and types inferred, stored once for the scans that follow."""
    return materialise(read_inferred(spark, path, detect_delimiter(spark, path), encoding), "delimited")


def load_text(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with its separator found, all text, stored once: types are decided with the other side's values in view.

    A record that does not fit the header is an error.
    """
    return materialise(read_text_columns(spark, path, detect_delimiter(spark, path), encoding), "delimited")


def _brought_together(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame, Check]:
    """Both sides normalised under common decisions, and a check row on what conversions would have lost."""
    both = normalise_pair(source, target)
    sides = lambda held: {c: {"source": a, "target": b} for c, (a, b) in held.items()}
    kept, orders, doubt = sides(both.kept_as_text), sides(both.orders), sides(both.ambiguous)
    check = verdict(
        LOAD,
        "type_conversion",
        True,
        f"{len(both.converted)} text column(s) read as dates or numbers; {len(kept)} left as text, as values would have been lost; "
        f"{len(doubt)} with days and months that could be read the other way round",
        "",
        {"converted": both.converted, "values_that_would_be_lost": kept, "date_orders": orders, "ambiguous_dates": doubt},
    )
    return both.source, both.target, check


def failed_to_load(spark: SparkSession, cfg: Comparison, name: str, message: str, details: dict | None = None) -> Report:
    """The report of a comparison that could not begin."""
    run_id = cfg.run_name()
    layers = {LOAD: [Check(LOAD, name, FAILED, message, details or {})]}
    return Report(spark, replace(cfg, run=run_id), run_id, layers, load_error=message)


def _isolated(layer: str, work: Callable[[], list[Check]]) -> list[Check]:
    """A layer that breaks is a failed layer, not a failed run."""
    try:
        return work()
    except Exception as error:  # noqa: BLE001
        return [
            Check(
                layer,
                "layer_execution_error",
                FAILED,
                f"the layer stopped with {type(error).__name__}: {error}",
                {"traceback": traceback.format_exc()},
            )
        ]


def validate(
    source: DataFrame | str,
    target: DataFrame | str,
    config: Comparison | None = None,
    spark: SparkSession | None = None,
    materialised: bool = False,
) -> Report:
    """Compare two tables in four layers.

    A failed first layer ends the comparison, the others all run. Inputs may be paths of
    delimited files. ``materialised`` writes both sides to the shared folder first, for
    inputs whose own plan is expensive: about seven scans follow.
    """
    began = time.perf_counter()
    cfg = config or Comparison()
    run_id = cfg.run_name()
    spark = spark or (source.sparkSession if isinstance(source, DataFrame) else SparkSession.getActiveSession())
    report = Report(spark, replace(cfg, run=run_id), run_id, {})
    try:
        by_path = isinstance(source, str) or isinstance(target, str)
        source, target = (load_text(spark, x) if isinstance(x, str) else x for x in (source, target))
        if by_path:
            source, target, conversion = _brought_together(source, target)
            report.layers[LOAD] = [conversion]
        if materialised:
            source, target = materialise(source, "source"), materialise(target, "target")
    except Exception as error:  # noqa: BLE001 - a table that does not load is a failed comparison
        report = failed_to_load(spark, report.config, "load_error", str(error), {"traceback": traceback.format_exc()})
        report.duration_ms = (time.perf_counter() - began) * 1000
        return report

    known: list[Facts] = []

    def facts() -> Facts:
        report.pair = align(source, target)
        known.append(gather(report.pair, cfg))
        return known[0]

    report.layers[STRUCTURAL] = _isolated(STRUCTURAL, lambda: structural.run(source, target, cfg, facts))
    gate = report.layer_status(STRUCTURAL)
    if gate == PASSED and not cfg.wants(STRUCTURAL):
        del report.layers[STRUCTURAL]
    if gate == PASSED:
        pair = report.pair
        with Jobs(at_once=8) as jobs:
            # The digests go first: most other jobs wait for what they settle.
            if cfg.wants(DATA_LEVEL):
                data_level.start(pair, cfg, known[0], jobs)
            if cfg.wants(BUSINESS) or cfg.wants(STATISTICAL):
                # One ranking of the values serves both layers.
                business.start(source, target, pair, cfg, known[0], jobs)
            if cfg.wants(STATISTICAL):
                statistics.start(pair, cfg, known[0], jobs)
            for layer, plan in ((DATA_LEVEL, data_level), (BUSINESS, business), (STATISTICAL, statistics)):
                if cfg.wants(layer):
                    report.layers[layer] = _isolated(layer, lambda plan=plan: plan.run(pair, cfg, known[0], jobs))
    report.duration_ms = (time.perf_counter() - began) * 1000
    return report
