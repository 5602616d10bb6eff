"""Order-free digests of a table, its columns and its buckets, in one scan of each side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from concordat.functions.digest import (
    FINGERPRINTS,
    PIECE_BITS,
    PIECES,
    digest_aggregates,
    digest_sum,
    digest_xor,
    regroup_aggregates,
)
from concordat.functions.sql import aggregate, literal, struct, unpivot
from concordat.operators.pairing import IS_SOURCE, Pair, both_sides

ROW = "row"


def _value_name(i: int) -> str:
    return f"c{i}"


def bucket_of(pair: Pair, key: list[str], buckets: int, kind: str = "fast") -> str:
    """Rows are spread by key, or by whole row without one, so that a changed row can only
    touch the bucket (with a key) it lives in on both sides."""
    _, row_fp = FINGERPRINTS[kind]
    return f"CAST(pmod({row_fp(pair.typed(key or None))}, {buckets}) AS int)"


def bucket_digests(pair: Pair, key: list[str], buckets: int = 10, kind: str = "fast", columns: bool = True) -> DataFrame:
    """Partial digests per side and bucket; everything below is derived from these few rows."""
    value_fp, row_fp = FINGERPRINTS[kind]
    typed = pair.typed()
    fps = {ROW: row_fp(typed)}
    if columns:
        fps |= {_value_name(i): value_fp(c, t) for i, (c, t) in enumerate(typed)}
    hashed = pair.tagged(f"{bucket_of(pair, key, buckets, kind)} AS bucket", *[f"{e} AS {n}" for n, e in fps.items()])
    aggs = {"rows": "count(1)"}
    for n in fps:
        aggs |= digest_aggregates(n, n)
    return aggregate(hashed, [IS_SOURCE, "bucket"], aggs)


def _whole(partial: DataFrame, names: list[str]) -> DataFrame:
    aggs = {"rows": "sum(rows)"}
    for n in names:
        aggs |= regroup_aggregates(n)
    return aggregate(partial, [IS_SOURCE], aggs)


def _digest_columns(name: str) -> list[str]:
    return [f"{digest_sum(name)} AS digest_sum", f"{digest_xor(name)} AS digest_xor"]


def dataset_digest(partial: DataFrame) -> DataFrame:
    """(is_source, rows, digest_sum, digest_xor); a side without rows has no row here."""
    return _whole(partial, [ROW]).selectExpr(IS_SOURCE, "rows", *_digest_columns(ROW))


def column_digests(partial: DataFrame, columns: list[str]) -> DataFrame:
    """(is_source, column, rows, digest_sum, digest_xor)."""
    names = {c: _value_name(i) for i, c in enumerate(columns)}
    rows = [
        struct(column=literal(c), rows="rows", digest_sum=digest_sum(n), digest_xor=digest_xor(n)) for c, n in names.items()
    ]
    return unpivot(_whole(partial, list(names.values())), [IS_SOURCE], rows)


def bucket_checksums(partial: DataFrame) -> DataFrame:
    """(is_source, bucket, rows, digest_sum, digest_xor)."""
    return partial.selectExpr(IS_SOURCE, "bucket", "rows", *_digest_columns(ROW))


def compare_digests(digests: DataFrame, by: list[str]) -> DataFrame:
    """Both sides on one row per ``by``: counts, digests and ``matches``. A bucket or table
    that has rows on one side only does not match."""
    both = both_sides(digests, by, {"rows": "rows", "digest_sum": "digest_sum", "digest_xor": "digest_xor"})
    same = " AND ".join(f"source_{c} <=> target_{c}" for c in ("rows", "digest_sum", "digest_xor"))
    rest = [c for c in both.columns if c not in ("source_rows", "target_rows")]
    return both.selectExpr(
        *[f"`{c}`" for c in rest],
        "coalesce(source_rows, 0) AS source_rows",
        "coalesce(target_rows, 0) AS target_rows",
        f"{same} AS matches",
    )


def roll_up(partial_rows: list, columns: list[str]) -> dict[str, dict]:
    """The same three comparisons from collected ``bucket_digests``: two rows per bucket,
    so one small job answers for the table, its columns and its buckets.

    Returns {"table" | "column" | "bucket": {name: {"source": ..., "target": ..., "matches"}}}
    with (rows, sum, xor) per side.
    """
    names = {c: _value_name(i) for i, c in enumerate(columns)}

    def total(rows: list, stem: str) -> tuple[int, str, int]:
        xor = 0
        for r in rows:
            xor ^= r[f"{stem}_xor"]
        whole = sum(r[f"{stem}_p{i}"] << (PIECE_BITS * i) for r in rows for i in range(PIECES))
        return sum(r["rows"] for r in rows), str(whole), xor

    def compare(rows: list, stem: str) -> dict:
        source = total([r for r in rows if r[IS_SOURCE]], stem)
        target = total([r for r in rows if not r[IS_SOURCE]], stem)
        return {"source": source, "target": target, "matches": source == target}

    by_bucket: dict[int, list] = {}
    for r in partial_rows:
        by_bucket.setdefault(r["bucket"], []).append(r)
    return {
        "table": {"all": compare(partial_rows, ROW)},
        "column": {c: compare(partial_rows, n) for c, n in names.items()},
        "bucket": {b: compare(rows, ROW) for b, rows in sorted(by_bucket.items())},
    }
