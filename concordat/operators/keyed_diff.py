"""Row and cell differences under a key.

Rows are matched by a grouped aggregate over (key, row hashes), not by a join: what crosses
the network is the key and two 64-bit hashes, never the row, and a key that repeats (on
one side or both) stays one group instead of multiplying. Whole rows are fetched only for
the keys that turned out to differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions.digest import canonical_text, row_hash
from concordat.functions.numbers import absolute_diff, relative_diff
from concordat.functions.sql import aggregate, literal, quoted, struct, unpivot
from concordat.operators import lookup
from concordat.operators.pairing import FROM_SOURCE, FROM_TARGET, IS_SOURCE, Pair
from concordat.session import materialise

CHANGED, MISSING, EXTRA = "changed", "missing_in_target", "extra_in_target"
HASHES = ("__h0", "__h1")
PIECE_BITS, PIECES = 22, 3


def row_diff(pair: Pair, key: list[str]) -> DataFrame:
    """(key..., source_rows, target_rows, difference) for every key that differs.

    Null keys are keys. Repeated keys compare as multisets of rows: ``changed`` unless the
    same rows stand on both sides.
    """
    others = [c for c in pair.columns if c not in key]
    hashes = [f"{row_hash(pair.typed(others), seed)} AS {h}" for seed, h in enumerate(HASHES)] if others else []
    thin = pair.tagged(*map(quoted, key), *hashes)
    aggs = {"source_rows": f"count_if({FROM_SOURCE})", "target_rows": f"count_if({FROM_TARGET})"}
    # Source minus target, in 22-bit pieces: equal multisets sum to zero in each piece, and
    # a key with 10**12 equal rows still sums inside a bigint.
    balances = []
    for h in HASHES[: len(hashes)]:
        for i in range(PIECES):
            piece = f"(shiftrightunsigned({h}, {PIECE_BITS * i}) & {(1 << PIECE_BITS) - 1}L)"
            aggs[f"{h}{i}"] = f"sum(CASE WHEN {FROM_SOURCE} THEN {piece} ELSE -{piece} END)"
            balances.append(f"{h}{i} <> 0")
    differs = " OR ".join(["source_rows <> target_rows", *balances])
    label = (
        f"CASE WHEN target_rows = 0 THEN '{MISSING}' WHEN source_rows = 0 THEN '{EXTRA}' ELSE '{CHANGED}' END AS difference"
    )
    return aggregate(thin, key, aggs).where(differs).selectExpr(*map(quoted, key), "source_rows", "target_rows", label)


def diff_counts(diff: DataFrame) -> DataFrame:
    """(difference, n_keys, source_rows, target_rows), complete and at most three rows."""
    sums = {"n_keys": "count(1)", "source_rows": "sum(source_rows)", "target_rows": "sum(target_rows)"}
    return aggregate(diff, ["difference"], sums)


def _same_key(key: list[str]) -> str:
    """Null-safe match of the key columns with their aliases from ``_as_marks``."""
    return " AND ".join(f"{quoted(k)} <=> __k{i}" for i, k in enumerate(key))


def _as_marks(keys: DataFrame, key: list[str], *more: str) -> DataFrame:
    return keys.selectExpr(*[f"{quoted(k)} AS __k{i}" for i, k in enumerate(key)], *more)


def cell_diff(pair: Pair, key: list[str], changed: DataFrame) -> DataFrame:
    """(key..., column, source_value, target_value, n) for the keys in ``changed``.

    Values are text. Of every changed key the values that stand on both sides equally often
    cancel out; for a key with one row a side the remaining pair is the changed cell. For a
    repeated key each unmatched value is listed on its own side with its count.
    """
    others = [c for c in pair.columns if c not in key]
    rows = lookup.rows_of(pair.tagged(), changed, key)
    cells = [struct(__column=literal(c), __value=canonical_text(quoted(c), pair.dtype(c))) for c in others]
    keys = list(map(quoted, key))
    values = aggregate(
        unpivot(rows, [*keys, IS_SOURCE], cells),
        [*key, "__column", "__value"],
        {"__surplus": f"sum(CASE WHEN {FROM_SOURCE} THEN 1 ELSE -1 END)"},
    ).where("__surplus <> 0")
    # Read three times below, so stored: it holds what differs, the row diff beneath it runs once.
    values = materialise(values, "changed-values")
    # One unmatched value a side makes a changed cell. The group has one row per distinct
    # unmatched value, and its counts combine before the shuffle.
    shape = aggregate(
        values,
        [*key, "__column"],
        {
            "__over": "sum(greatest(__surplus, 0))",
            "__under": "sum(greatest(-__surplus, 0))",
            "source_value": "max(CASE WHEN __surplus > 0 THEN __value END)",
            "target_value": "max(CASE WHEN __surplus < 0 THEN __value END)",
        },
    )
    single, column = "__over = 1 AND __under = 1", "__column AS `column`"
    paired = shape.where(single).selectExpr(*keys, column, "source_value", "target_value", "1L AS n")
    crowded = _as_marks(shape.where(f"NOT ({single})"), key, "__column AS __c")
    listed = values.join(crowded, F.expr(f"__column = __c AND {_same_key(key)}"), "left_semi").selectExpr(
        *keys,
        column,
        "CASE WHEN __surplus > 0 THEN __value END AS source_value",
        "CASE WHEN __surplus < 0 THEN __value END AS target_value",
        "abs(__surplus) AS n",
    )
    return paired.unionAll(listed)


def diff_sample(pair: Pair, key: list[str], diff: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` differing keys in key order with their rows from both sides."""
    first = diff.orderBy(*map(quoted, key)).limit(limit)
    return lookup.rows_of(pair.tagged(), first, key)


def key_differences(pair: Pair, key: list[str], columns: list[str]) -> DataFrame:
    """Numeric columns compared under the key instead of by rank.

    Rows (column, source_count, target_count, max_absolute_diff, max_relative_diff, missing_in_target,
    extra_in_target, repeated_keys, null_mismatches). Differences are over keys that hold one row on
    each side; counts are of non-null values over all rows. The other columns count what has no partner: keys of
    one side alone, keys with several rows on a side, and keys with a value on one side and null on the other.
    """
    index = dict(enumerate(columns))
    rows = pair.tagged(*map(quoted, key), *[f"{quoted(c)} AS __v{i}" for i, c in index.items()])
    aggs = {"__sn": f"count_if({FROM_SOURCE})", "__tn": f"count_if({FROM_TARGET})"}
    single = "__sn = 1 AND __tn = 1"
    finals = {
        "missing": "coalesce(count_if(__tn = 0), 0)",
        "extra": "coalesce(count_if(__sn = 0), 0)",
        "repeated": "coalesce(count_if(__sn > 0 AND __tn > 0 AND __sn + __tn > 2), 0)",
    }
    cells = []
    for i, c in index.items():
        for tag, side in (("s", FROM_SOURCE), ("t", FROM_TARGET)):
            value = f"CASE WHEN {side} THEN __v{i} END"
            aggs |= {f"__{tag}{i}": f"max({value})", f"__{tag}c{i}": f"count({value})"}
        s, t = f"__s{i}", f"__t{i}"
        finals |= {
            f"sc{i}": f"coalesce(sum(__sc{i}), 0)",
            f"tc{i}": f"coalesce(sum(__tc{i}), 0)",
            f"a{i}": f"max(CASE WHEN {single} THEN {absolute_diff(s, t)} END)",
            f"r{i}": f"max(CASE WHEN {single} THEN {relative_diff(s, t)} END)",
            f"u{i}": f"coalesce(count_if({single} AND ({s} IS NULL) <> ({t} IS NULL)), 0)",
        }
        cells.append(
            struct(
                column=literal(c),
                source_count=f"sc{i}",
                target_count=f"tc{i}",
                max_absolute_diff=f"a{i}",
                max_relative_diff=f"r{i}",
                missing_in_target="missing",
                extra_in_target="extra",
                repeated_keys="repeated",
                null_mismatches=f"u{i}",
            )
        )
    return unpivot(aggregate(aggregate(rows, key, aggs), [], finals), [], cells)
