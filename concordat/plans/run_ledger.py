"""What a run of many comparisons has finished, so that it can go on where it broke off."""

from __future__ import annotations

import hashlib
import json
import threading
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession

from concordat.config import Comparison
from concordat.plans.report import Check
from concordat.plans.validate import Report
from concordat.sinks.reports import write_checks, write_headers
from concordat.sources.paths import exists, files_below, read_small, write_small


def _identity(spark: SparkSession, table: DataFrame | str) -> list | None:
    """What a table is made of: its files as they are now, and the plan over them; None if rows come from elsewhere."""
    if isinstance(table, str):
        return files_below(spark, [table])
    plan = table._jdf.queryExecution().analyzed().canonicalized().toString()
    if any(kind in plan for kind in ("LogicalRDD", "LocalRelation", "ExternalRDD", "StreamingRelation")):
        return None
    return [plan, table.schema.json(), *files_below(spark, table.inputFiles())]


def content_key(spark: SparkSession, cfg: Comparison, *tables: DataFrame | str | None) -> str | None:
    """Equal for equal settings over the same files; None where inputs or settings cannot be told by it."""
    if any(callable(r.measure) for r in cfg.rules):
        return None
    parts = [None if t is None else _identity(spark, t) for t in tables]
    if any(p is None and t is not None for p, t in zip(parts, tables)):
        return None
    held = json.dumps([asdict(replace(cfg, run="")), parts], default=str, sort_keys=True)
    return hashlib.sha256(held.encode()).hexdigest()


class RunLedger:
    """One small file for each finished comparison of a run, beside the check rows."""

    def __init__(self, spark: SparkSession, report_path: str, run_id: str):
        self.spark, self.report_path = spark, str(report_path).rstrip("/")
        self.folder = f"{self.report_path}.ledger/{run_id}"
        self._lock = threading.Lock()

    def _file(self, name: str) -> str:
        return f"{self.folder}/{hashlib.sha256(name.encode()).hexdigest()[:32]}.json"

    def record(self, name: str, key: str | None, report: Report) -> None:
        """Note the result, write its rows, note that they are written."""
        held = {"comparison": name, "key": key, "checks": [asdict(c) for c in report.check_rows], "layers": list(report.layers), "written": False}
        held |= {"load_error": report.load_error, "duration_ms": report.duration_ms}
        with self._lock:
            write_small(self.spark, self._file(name), json.dumps(held, default=str))
            self._write(held, report)

    def _write(self, held: dict, report: Report) -> None:
        write_checks(report.checks, self.report_path)
        write_headers(self.spark, [report.header()], self.report_path)
        write_small(self.spark, self._file(held["comparison"]), json.dumps(held | {"written": True}, default=str))

    def finished(self, name: str, key: str | None, cfg: Comparison) -> Report | None:
        """The report of a comparison that was finished under the same key; its rows are written if they were not yet."""
        if key is None or not exists(self.spark, self._file(name)):
            return None
        held = json.loads(read_small(self.spark, self._file(name)))
        if held["key"] != key:
            return None
        checks = [Check(**c) for c in held["checks"]]
        layers = {layer: [c for c in checks if c.layer == layer] for layer in held["layers"]}
        report = Report(self.spark, replace(cfg, name=name), cfg.run, layers, held["duration_ms"], held["load_error"])
        if not held["written"]:
            with self._lock:
                self._write(held, report)
        return report
