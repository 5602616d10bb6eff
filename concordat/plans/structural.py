"""Layer 1, the gate: columns, types, nulls, order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from concordat.config import STRUCTURAL, Comparison
from concordat.functions.types import family
from concordat.plans.facts import Facts
from concordat.plans.report import Check, verdict


def run(source: DataFrame, target: DataFrame, cfg: Comparison, facts: Callable[[], Facts]) -> list[Check]:
    """``facts`` is called, and its job run, only if the column names agree."""
    s, t = source.columns, target.columns
    checks = [
        verdict(
            STRUCTURAL,
            "column_count",
            len(s) == len(t),
            f"{len(s)} columns on both sides",
            f"{cfg.sides[0]} has {len(s)} columns, {cfg.sides[1]} has {len(t)}",
            {"source_count": len(s), "target_count": len(t)},
        )
    ]
    missing, extra = sorted(set(s) - set(t)), sorted(set(t) - set(s))
    checks.append(
        verdict(
            STRUCTURAL,
            "column_names",
            not missing and not extra,
            "same column names on both sides",
            f"{cfg.sides[1]} lacks {missing} and adds {extra}",
            {"missing_in_target": missing, "extra_in_target": extra},
        )
    )
    if any(c.status == "FAILED" for c in checks):
        return checks

    types = {c: (source.schema[c].dataType, target.schema[c].dataType) for c in sorted(s)}
    clash = {
        c: {"source_type": a.simpleString(), "target_type": b.simpleString()}
        for c, (a, b) in types.items()
        if family(a) != family(b)
    }
    checks.append(
        verdict(
            STRUCTURAL,
            "data_types",
            not clash,
            "types are of the same family in every column",
            f"type families differ in {len(clash)} column(s): {sorted(clash)}",
            {"mismatches": clash},
        )
    )
    known = facts()
    off = {
        c: {"source_nulls": known.nulls(True, c), "target_nulls": known.nulls(False, c)}
        for c in sorted(s)
        if known.nulls(True, c) != known.nulls(False, c)
    }
    checks.append(
        verdict(
            STRUCTURAL,
            "null_counts",
            not off,
            "null counts agree in every column",
            f"null counts differ in {len(off)} column(s)",
            {"null_issues": off},
            known.duration_ms,
        )
    )
    if cfg.ordered:
        checks.append(
            verdict(
                STRUCTURAL,
                "column_order",
                s == t,
                "columns stand in the same order",
                "columns stand in a different order",
                {"source_order": s, "target_order": t},
            )
        )
    return checks
