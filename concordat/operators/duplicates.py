"""Whole-row duplicates on each side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from concordat.functions.digest import row_hash
from concordat.functions.sql import aggregate, quoted
from concordat.operators.pairing import FROM_SOURCE, FROM_TARGET, IS_SOURCE, Pair

def _excess(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of each distinct row. Equal rows fold before the shuffle."""
    grouped = aggregate(rows, [IS_SOURCE, *columns], {"__n": "count(1)"})
    return grouped.where("__n > 1").selectExpr(
        f"coalesce(sum(CASE WHEN {FROM_SOURCE} THEN __n - 1 END), 0) AS source_duplicates",
        f"coalesce(sum(CASE WHEN {FROM_TARGET} THEN __n - 1 END), 0) AS target_duplicates",
    )


def duplicate_rows(pair: Pair) -> DataFrame:
    """One row (source_duplicates, target_duplicates), exact.

    The table is first grouped by two 64-bit row hashes, so 16 bytes a row are shuffled and not the row: rows whose
    hashes are unique cannot be duplicates. Only rows sharing both hashes are then compared by content.
    """
    hashes = [f"{row_hash(pair.typed(), seed)} AS __h{seed}" for seed in (0, 1)]
    keys = [IS_SOURCE, "__h0", "__h1"]
    suspects = aggregate(pair.tagged(*hashes), keys, {"__n": "count(1)"}).where("__n > 1").select(*keys)
    whole = pair.tagged(*[quoted(c) for c in pair.columns], *hashes)
    return _excess(whole.join(suspects, keys, "left_semi"), pair.columns)
