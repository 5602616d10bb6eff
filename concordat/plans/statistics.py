"""Layer 4: profiles, null ratios, cardinality, confidence."""

from __future__ import annotations

from concordat.config import STATISTICAL, Comparison
from concordat.operators import cardinality, order_stats
from concordat.operators.pairing import Pair
from concordat.operators.profile import MOMENTS
from concordat.plans.business import ranked
from concordat.plans.facts import Facts
from concordat.plans.jobs import Jobs
from concordat.plans.report import Check, skipped, verdict

CONFIDENCE = 0.95


def _cardinality(pair: Pair, cfg: Comparison, jobs: Jobs) -> list[dict]:
    """Columns whose digests agree have the same distinct count; only the others are counted."""
    _, same = jobs.alike(pair.columns)
    other = pair.subset([c for c in pair.columns if c not in same])
    if not other.columns:
        return []
    return [r.asDict() for r in cardinality.cardinality(other, cfg.statistics.drift, cfg.statistics.distinct_error).collect()]


def _percentiles(cfg: Comparison, found: list[dict]) -> dict:
    """(is_source, column, stat) -> value, from the rows of the ranking jobs."""
    out = {}
    for r in found:
        for side, key in ((True, "source_percentiles"), (False, "target_percentiles")):
            for p, value in zip(cfg.statistics.quantiles, r.get(key) or []):
                out[(side, r["column"], order_stats.percentile_name(p))] = value
    return out


def start(pair: Pair, cfg: Comparison, facts: Facts, jobs: Jobs) -> None:
    if not pair.numeric_columns():
        return
    jobs.start("cardinality", _cardinality, pair, cfg, jobs)


def run(pair: Pair, cfg: Comparison, facts: Facts, jobs: Jobs) -> list[Check]:
    numeric = pair.numeric_columns()
    if not numeric:
        return [
            skipped(
                STATISTICAL, "statistical_profile", "there are no numeric columns", "runs once a numeric column is present"
            )
        ]
    found, ms = ranked(jobs)
    percentiles = _percentiles(cfg, found)
    profiles, issues, stats = {}, [], 0
    names = [order_stats.percentile_name(p) for p in cfg.statistics.quantiles]
    for c in numeric:
        sides = []
        for side in (True, False):
            values = {m: facts.moment(side, c, m) for m in MOMENTS}
            values |= {n: percentiles.get((side, c, n)) for n in names}
            sides.append(values)
        own = []
        for stat, s in sides[0].items():
            t = sides[1][stat]
            if s is None or t is None:
                continue
            rel = abs(s - t) / (abs(s) or 1.0)
            if rel > cfg.statistics.drift:
                own.append({"column": c, "stat": stat, "source": s, "target": t, "relative_diff": round(rel, 6)})
        counted = [
            {"non_null": facts.row_count(side) - facts.nulls(side, c), "null_ratio": round(facts.null_ratio(side, c), 6)}
            for side in (True, False)
        ]
        profiles[c] = {"source": sides[0] | counted[0], "target": sides[1] | counted[1], "issues": own}
        issues += own
        stats += len(sides[0])
    checks = [
        verdict(
            STATISTICAL,
            "per_column_statistics",
            not issues,
            f"profiles agree in {len(numeric)} numeric column(s)",
            f"{len(issues)} statistic(s) deviate",
            {
                "tolerance": cfg.statistics.drift,
                "columns_checked": numeric,
                "column_profiles": profiles,
                "issues": issues,
            },
            ms + facts.duration_ms,
        )
    ]
    ratios = []
    for c in pair.columns:
        s, t = facts.null_ratio(True, c), facts.null_ratio(False, c)
        if abs(s - t) > cfg.statistics.drift:
            ratios.append(
                {"column": c, "source_null_ratio": round(s, 6), "target_null_ratio": round(t, 6), "delta": round(abs(s - t), 6)}
            )
    checks.append(
        verdict(
            STATISTICAL,
            "null_ratio",
            not ratios,
            "null ratios agree in every column",
            f"null ratios differ in {len(ratios)} column(s)",
            {"issues": ratios},
            facts.duration_ms,
        )
    )
    counted, ms_card = jobs.result("cardinality")
    off = [r for r in counted if r["deviates"]]
    checks.append(
        verdict(
            STATISTICAL,
            "cardinality",
            not off,
            "distinct counts agree in every column",
            f"distinct counts differ in {len(off)} column(s)",
            {"issues": off},
            ms_card,
        )
    )
    score = (stats - len(issues)) / stats if stats else 1.0
    checks.append(
        verdict(
            STATISTICAL,
            "distribution_confidence",
            score >= CONFIDENCE,
            f"{score:.1%} of the statistics agree",
            f"only {score:.1%} of the statistics agree, {CONFIDENCE:.0%} are needed",
            {"score": round(score, 4), "threshold": CONFIDENCE},
            ms,
        )
    )
    return checks
