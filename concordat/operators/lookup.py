"""Whole rows for given keys, when one key may hold any share of the rows.

Keys that fit are sent to every executor, and no row moves. Where they are too many, a frequent-items sketch of the rows' keys names the
few that hold over a thousandth of the rows each; those keys are sent to every executor, and only the others' rows are
shuffled, none of whose keys is heavy. Null is a key like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions.digest import row_hash
from concordat.functions.sql import quoted
from concordat.session import materialise

BROADCAST_BYTES = 32 << 20
HEAVY_SHARE = 1000  # a key with over one in so many rows is heavy
_HASH = "__key_hash"


def _same_key(key: list[str]) -> str:
    return " AND ".join(f"{quoted(k)} <=> __k{i}" for i, k in enumerate(key))


def _marks(keys: DataFrame, key: list[str], *more: str) -> DataFrame:
    return keys.selectExpr(*[f"{quoted(k)} AS __k{i}" for i, k in enumerate(key)], *more)


def _key_hash(df: DataFrame, key: list[str]) -> str:
    return row_hash([(quoted(k), df.schema[k].dataType) for k in key])


def heavy_hashes(rows: DataFrame, key: list[str], share: int = HEAVY_SHARE) -> list[int]:
    """Hashes of the keys that hold over one in ``share`` of the rows; at most ``share`` of them.

    The sketch holds ten times as many, so it misses none of them and reports counts no lower than they are.
    """
    hashed = rows.selectExpr(f"{_key_hash(rows, key)} AS h")
    top = hashed.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {share}, {10 * share})").alias("top")).first()
    return [i["item"] for i in top["top"] or [] if i["count"] * share > top["n"]]


def rows_of(rows: DataFrame, keys: DataFrame, key: list[str], most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows whose key is among the distinct ``keys``."""
    held = materialise(keys.select(*map(quoted, key)).distinct(), "keys")
    size = held.selectExpr(f"sum({' + '.join(f'coalesce(octet_length(CAST({quoted(k)} AS string)), 0) + 16' for k in key)}) AS bytes").first()["bytes"]
    if (size or 0) <= most_bytes:
        return rows.join(F.broadcast(_marks(held, key)), F.expr(_same_key(key)), "left_semi")
    heavy = heavy_hashes(rows, key)
    names = rows.columns
    hashed = rows.selectExpr("*", f"{_key_hash(rows, key)} AS {_HASH}")
    marked = _marks(held, key, f"{_key_hash(held, key)} AS __kh")
    listed = rows.sparkSession.createDataFrame([(h,) for h in heavy], "heavy_hash bigint")
    is_heavy = lambda df, column, how: df.join(F.broadcast(listed), F.col(column) == F.col("heavy_hash"), how)
    # Keys with a heavy hash are as few as the hashes.
    some = is_heavy(hashed, _HASH, "left_semi").join(F.broadcast(is_heavy(marked, "__kh", "left_semi")), F.expr(_same_key(key)), "left_semi")
    rest = is_heavy(hashed, _HASH, "left_anti").join(is_heavy(marked, "__kh", "left_anti"), F.expr(_same_key(key)), "left_semi")
    return some.unionAll(rest).select(*map(quoted, names))
