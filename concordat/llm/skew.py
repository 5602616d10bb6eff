"""Taking what a group decided back to its rows when one group may hold a third of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``key``, with its number of rows in ``size``).

    Groups with over a thousandth of ``total`` rows are fewer than a thousand, so they are broadcast; the
    others are joined by a shuffle in which no key is heavy.
    """
    heavy, light = groups.where(F.col(size) * HEAVY > total), groups.where(F.col(size) * HEAVY <= total)
    added = [c for c in groups.columns if c != key]
    first = rows.join(F.broadcast(heavy), key, "left")
    rest = first.where(F.col(size).isNull()).drop(*added).join(light, key)
    return first.where(F.col(size).isNotNull()).unionByName(rest)
