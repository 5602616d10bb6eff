"""Layer 3: totals, tolerances by rank, groups, custom rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.config import BUSINESS, Comparison
from concordat.functions.sql import quoted
from concordat.functions.types import family
from concordat.operators import order_stats, totals
from concordat.operators.pairing import Pair, as_doubles, source_only
from concordat.plans.facts import Facts
from concordat.plans.jobs import Jobs
from concordat.plans.report import Check, skipped, verdict
from concordat.session import stored


def within(a, b, absolute: float, relative: float) -> bool:
    """``functions.numbers.within_tolerance`` for two collected values."""
    if a is None or b is None:
        return a is None and b is None
    try:
        x, y = float(a), float(b)
    except (TypeError, ValueError):
        return str(a) == str(b)
    return x == y or abs(x - y) <= absolute or abs(x - y) / (abs(x) or 1.0) <= relative


def _shared_totals(pair: Pair, cfg: Comparison) -> tuple[list[str], list[str]]:
    known = [c for c in cfg.totals.of if c in pair.columns]
    return known, [c for c in cfg.totals.of if c not in pair.columns]


def _ranking_pair(pair: Pair, facts: Facts) -> Pair:
    """Integers a double holds exactly join the doubles, for one pass instead of two."""
    integers = [c for c in pair.numeric_columns() if family(pair.dtype(c)) == "integer"]
    return as_doubles(pair, [c for c in integers if facts.largest(c) <= order_stats.EXACT_IN_DOUBLE])


def _ranks(pair: Pair, cfg: Comparison, facts: Facts, jobs: Jobs) -> list[dict]:
    """Differences by rank and percentiles of the columns whose digests do not agree."""
    _, same = jobs.alike(pair.numeric_columns())
    columns = [c for c in pair.numeric_columns() if c not in same]
    if not columns:
        return []
    found = order_stats.rank_differences(
        _ranking_pair(pair, facts),
        columns,
        cfg.statistics.rows_per_bin,
        max(facts.row_count(True), facts.row_count(False)),
        percentiles=cfg.statistics.quantiles,
        numbers={(side, c): facts.numbers(side, c) for side in (True, False) for c in columns},
    )
    rows = order_stats.exceeds_tolerance(found, {c: cfg.tolerances.limits(c) for c in columns}).collect()
    return [r.asDict() for r in rows]


def _percentiles_of_same(pair: Pair, cfg: Comparison, facts: Facts, jobs: Jobs) -> list[dict]:
    """The same rows for columns whose digests agree: there is no difference to look for, and
    the percentiles of one side, which take no shuffle of the values, are those of both."""
    _, same = jobs.alike(pair.numeric_columns())
    if not same:
        return []
    one_side, rows = source_only(_ranking_pair(pair, facts)), facts.row_count(True)
    read = order_stats.column_percentiles(one_side, same, cfg.statistics.quantiles, cfg.statistics.rows_per_bin, rows).collect()
    stats = {(r["column"], r["stat"]): r["value"] for r in read}
    out = []
    for c in same:
        values = [stats.get((c, order_stats.percentile_name(p))) for p in cfg.statistics.quantiles]
        n, (absolute, relative) = facts.numbers(True, c), cfg.tolerances.limits(c)
        out.append(
            {
                "column": c,
                "source_count": n,
                "target_count": n,
                "max_absolute_diff": 0.0 if n else None,
                "max_relative_diff": 0.0 if n else None,
                "source_percentiles": values,
                "target_percentiles": values,
                "abs_tolerance": absolute,
                "rel_tolerance": relative,
                "exceeds": False,
            }
        )
    return out


def ranked(jobs: Jobs) -> tuple[list[dict], float]:
    """One row per numeric column, from both jobs."""
    (unlike, ms), (same, ms_same) = jobs.result("ranks"), jobs.result("percentiles")
    return unlike + same, max(ms, ms_same)


def _groups(pair: Pair, cfg: Comparison, columns: list[str]) -> dict:
    by = cfg.totals.within
    wrong = totals.group_consistency(pair, by, columns, cfg.tolerances.others.absolute).where(~F.col("agrees"))
    with stored(wrong, "groups") as grouped:
        found = grouped.groupBy("column").agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.count_if(F.col("source_rows") == 0).alias("only_in_target"),
            F.count_if(F.col("target_rows") == 0).alias("only_in_source"),
        )
        counts = {r["column"]: r.asDict() for r in found.collect()}
        first = {c: grouped.where(F.col("column") == c).orderBy(*map(quoted, by)).limit(cfg.samples.groups) for c in counts}
        shown = {c: [r.asDict() for r in df.collect()] for c, df in first.items()}
    truncated = any(counts[c]["n_groups"] > len(shown[c]) for c in counts)
    return {"counts": counts, "shown": shown, "sample_truncated": truncated}


def start(source: DataFrame, target: DataFrame, pair: Pair, cfg: Comparison, facts: Facts, jobs: Jobs) -> None:
    if pair.numeric_columns():
        jobs.start("ranks", _ranks, pair, cfg, facts, jobs)
        jobs.start("percentiles", _percentiles_of_same, pair, cfg, facts, jobs)
    known, _ = _shared_totals(pair, cfg)
    if cfg.totals.within and known:
        jobs.start("groups", _groups, pair, cfg, known)
    if cfg.rules:
        jobs.start("rules", totals.rule_outcomes, source, target, cfg.rules)


def run(pair: Pair, cfg: Comparison, facts: Facts, jobs: Jobs) -> list[Check]:
    return [_totals(pair, cfg, facts), _tolerance(pair, jobs), _group_sums(pair, cfg, jobs), *_rules(cfg, jobs)]


def _totals(pair: Pair, cfg: Comparison, facts: Facts) -> Check:
    name = "grand_total_aggregations"
    if not cfg.totals.of:
        return skipped(BUSINESS, name, "no columns to total", "set totals, e.g. Totals(['revenue'])")
    known, unknown = _shared_totals(pair, cfg)
    issues: list[dict] = [{"column": c, "error": "no such column"} for c in unknown]
    for c in known:
        for fn in ("SUM", "COUNT", "AVG"):
            s, t = facts.total(True, c, fn), facts.total(False, c, fn)
            if not within(s, t, cfg.tolerances.others.absolute, cfg.tolerances.others.relative):
                delta = None if s is None or t is None else s - t
                issues.append({"column": c, "function": fn, "source": s, "target": t, "delta": delta})
    return verdict(
        BUSINESS,
        name,
        not issues,
        f"sum, count and average agree for {len(known)} column(s)",
        f"{len(issues)} total(s) disagree",
        {"issues": issues},
        facts.duration_ms,
    )


def _tolerance(pair: Pair, jobs: Jobs) -> Check:
    name = "float_tolerance"
    columns = pair.numeric_columns()
    if not columns:
        return skipped(BUSINESS, name, "there are no numeric columns", "runs by itself once a numeric column is present")
    found, ms = ranked(jobs)
    over = [{k: v for k, v in r.items() if not k.endswith("_percentiles")} for r in found if r["exceeds"]]
    return verdict(
        BUSINESS,
        name,
        not over,
        f"values agree within tolerance in {len(columns)} numeric column(s)",
        f"values exceed the tolerance in {len(over)} numeric column(s)",
        {"issues": over, "columns_checked": columns},
        ms,
    )


def _group_sums(pair: Pair, cfg: Comparison, jobs: Jobs) -> Check:
    name = "group_by_consistency"
    if not cfg.totals.within:
        return skipped(BUSINESS, name, "no columns to group by", "set totals, e.g. Totals(['revenue'], ['region'])")
    if not cfg.totals.of:
        return skipped(BUSINESS, name, "no columns to total per group", "name the columns to add up in totals")
    known, unknown = _shared_totals(pair, cfg)
    details: dict = {"ignored_columns": unknown}
    if not known:
        return verdict(BUSINESS, name, True, "none of the columns to total exists, nothing to compare", "", details)
    try:
        found, ms = jobs.result("groups")
    except Exception as error:  # noqa: BLE001 - an unusable grouping is this check's finding
        return verdict(BUSINESS, name, False, "", f"group sums could not be computed: {error}", {"error": str(error)})
    details |= found
    n = sum(c["n_groups"] for c in found["counts"].values())
    return verdict(
        BUSINESS, name, not n, f"group sums agree on {cfg.totals.within}", f"{n:,} group sum(s) disagree", details, ms
    )


def _rules(cfg: Comparison, jobs: Jobs) -> list[Check]:
    if not cfg.rules:
        return [skipped(BUSINESS, "custom_rules", "there are no custom rules", "add Rule entries to rules")]
    outcomes, ms = jobs.result("rules")
    checks = []
    for rule, o in zip(cfg.rules, outcomes):
        if o.error is not None:
            checks.append(
                verdict(BUSINESS, f"rule_{o.name}", False, "", f"rule '{o.name}' could not run: {o.error}", {"error": o.error})
            )
            continue
        ok = within(o.source, o.target, rule.margin, rule.margin)
        both = f"{cfg.sides[0]} {o.source}, {cfg.sides[1]} {o.target}"
        checks.append(
            verdict(
                BUSINESS,
                f"rule_{o.name}",
                ok,
                f"rule '{o.name}' holds: {both}",
                f"rule '{o.name}' is broken: {both}",
                {"source": o.source, "target": o.target},
                ms,
            )
        )
    return checks
