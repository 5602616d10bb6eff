"""Layer 2: row counts, digests, duplicates, buckets, keyed differences."""

from __future__ import annotations

from concordat.config import DATA_LEVEL, Comparison
from concordat.operators import digest_tree, duplicates, fingerprint, keyed_diff
from concordat.operators.pairing import IS_SOURCE, Pair, source_only
from concordat.plans.facts import Facts
from concordat.plans.jobs import Jobs
from concordat.plans.report import Check, skipped, verdict
from concordat.session import stored

# What unequal row counts leave unanswered in this layer.
NOT_RUN = ["full_dataset_hash", "column_level_hash", "duplicate_rows", "bucketed_checksum", "row_aligned_diff"]


def usable_key(pair: Pair, cfg: Comparison) -> list[str]:
    return cfg.key if cfg.key and set(cfg.key) <= set(pair.columns) else []


def _digests(pair: Pair, cfg: Comparison) -> dict[str, dict]:
    partial = fingerprint.bucket_digests(pair, usable_key(pair, cfg), cfg.buckets)
    return fingerprint.roll_up(partial.collect(), pair.columns)


def _duplicates(pair: Pair, jobs: Jobs) -> dict[str, int]:
    same_rows, _ = jobs.alike(pair.columns)
    found = duplicates.duplicate_rows(source_only(pair) if same_rows else pair).first().asDict()
    return found | {"target_duplicates": found["source_duplicates"]} if same_rows else found


def _diff(pair: Pair, cfg: Comparison, facts: Facts, jobs: Jobs) -> dict:
    if jobs.alike(pair.columns)[0]:
        return {"counts": {}, "sample": [], "truncated": False}
    rows = facts.row_count(True) + facts.row_count(False)
    opened = digest_tree.drill_down(pair, cfg.key).pair if rows > digest_tree.FEW_ROWS else pair
    with stored(keyed_diff.row_diff(opened, cfg.key), "row-diff") as diff:
        counts = {r["difference"]: r.asDict() for r in keyed_diff.diff_counts(diff).collect()}
        sample, truncated = [], sum(r["n_keys"] for r in counts.values()) > cfg.samples.keys
        if counts:
            # A repeated key may bring any number of rows: the sample shows a bounded part, and says so.
            found = keyed_diff.diff_sample(pair, cfg.key, diff, cfg.samples.keys).orderBy(*cfg.key, IS_SOURCE)
            rows = found.limit(cfg.samples.rows + 1).collect()
            sample = [r.asDict() for r in rows[: cfg.samples.rows]]
            truncated |= len(rows) > cfg.samples.rows
    return {"counts": counts, "sample": sample, "truncated": truncated}


def start(pair: Pair, cfg: Comparison, facts: Facts, jobs: Jobs) -> None:
    if facts.row_count(True) != facts.row_count(False):
        return
    jobs.start("digests", _digests, pair, cfg)
    jobs.start("duplicates", _duplicates, pair, jobs)
    if usable_key(pair, cfg):
        jobs.start("row_diff", _diff, pair, cfg, facts, jobs)


def run(pair: Pair, cfg: Comparison, facts: Facts, jobs: Jobs) -> list[Check]:
    s, t = facts.row_count(True), facts.row_count(False)
    checks = [
        verdict(
            DATA_LEVEL,
            "row_count",
            s == t,
            f"{s:,} rows on both sides",
            f"{cfg.sides[0]} has {s:,} rows, {cfg.sides[1]} has {t:,}: {abs(s - t):,} apart",
            {"source_rows": s, "target_rows": t, "delta": s - t} | ({} if s == t else {"not_run": NOT_RUN}),
            facts.duration_ms,
        )
    ]
    if s != t:
        return checks

    digests, ms = jobs.result("digests")
    whole = digests["table"]["all"]
    checks.append(
        verdict(
            DATA_LEVEL,
            "full_dataset_hash",
            whole["matches"],
            "the tables have the same digest",
            "the tables have different digests",
            whole,
            ms,
        )
    )
    unlike = [c for c, d in digests["column"].items() if not d["matches"]]
    checks.append(
        verdict(
            DATA_LEVEL,
            "column_level_hash",
            not unlike,
            f"digests agree in all {len(pair.columns)} columns",
            f"digests differ in {len(unlike)} column(s): {unlike}",
            {"column_hashes": digests["column"], "mismatched_columns": unlike},
            ms,
        )
    )
    dup, ms_dup = jobs.result("duplicates")
    checks.append(
        verdict(
            DATA_LEVEL,
            "duplicate_rows",
            dup["source_duplicates"] == dup["target_duplicates"],
            f"{dup['source_duplicates']:,} repeated rows on both sides",
            f"{dup['source_duplicates']:,} repeated rows in {cfg.sides[0]}, "
            f"{dup['target_duplicates']:,} in {cfg.sides[1]}",
            dup,
            ms_dup,
        )
    )
    off = [{"bucket": b} | d for b, d in digests["bucket"].items() if not d["matches"]]
    checks.append(
        verdict(
            DATA_LEVEL,
            "bucketed_checksum",
            not off,
            f"digests agree in all {cfg.buckets} buckets",
            f"digests differ in {len(off)} bucket(s)",
            {"mismatched_buckets": off},
            ms,
        )
    )
    checks.append(_row_aligned(pair, cfg, jobs))
    return checks


def _row_aligned(pair: Pair, cfg: Comparison, jobs: Jobs) -> Check:
    name = "row_aligned_diff"
    if not cfg.key:
        return skipped(DATA_LEVEL, name, "rows cannot be matched without a key", "set key, e.g. ['order_id']")
    if not usable_key(pair, cfg):
        absent = sorted(set(cfg.key) - set(pair.columns))
        return verdict(DATA_LEVEL, name, False, "", f"key columns not in the table: {absent}", {"missing_key_columns": absent})
    found, ms = jobs.result("row_diff")
    total = sum(r["n_keys"] for r in found["counts"].values())
    return verdict(
        DATA_LEVEL,
        name,
        total == 0,
        "every key has the same rows on both sides",
        f"{total:,} key(s) differ: " + ", ".join(f"{k} {v['n_keys']:,}" for k, v in sorted(found["counts"].items())),
        {"differing_keys": total, "by_difference": found["counts"], "sample": found["sample"], "sample_truncated": found["truncated"]},
        ms,
    )
