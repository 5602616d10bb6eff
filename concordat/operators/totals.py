"""Totals over the whole table, per group, and of custom rules."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.config import Rule
from concordat.functions.numbers import as_number, summable, within_tolerance
from concordat.functions.sql import aggregate, literal, quoted, struct, unpivot
from concordat.operators.pairing import FROM_SOURCE, FROM_TARGET, IS_SOURCE, Pair, both_sides

SUM_NOISE = "1e-12"


def grand_totals(pair: Pair, columns: list[str], absolute: float, relative: float) -> DataFrame:
    """(column, function, source_value, target_value, agrees): SUM, COUNT and AVG of both
    sides in one pass."""
    aggs, cells = {}, []
    for i, c in enumerate(columns):
        v, dtype = as_number(quoted(c), pair.dtype(c)), pair.dtype(c)
        aggs |= {
            f"SUM{i}": f"coalesce(CAST(sum({summable(quoted(c), dtype)}) AS double), 0D)",
            f"COUNT{i}": f"CAST(count({v}) AS double)",
            f"AVG{i}": f"avg(CAST({v} AS double))",
        }
        cells += [struct(column=literal(c), function=literal(fn), value=f"{fn}{i}") for fn in ("SUM", "COUNT", "AVG")]
    long = unpivot(aggregate(pair.tagged(*map(quoted, columns)), [IS_SOURCE], aggs), [IS_SOURCE], cells)
    both = both_sides(long, ["column", "function"], {"value": "value"})
    # A side without rows yields no total at all: sum and count of nothing are zero.
    filled = [
        f"CASE WHEN function = 'AVG' THEN {side}_value ELSE coalesce({side}_value, 0D) END AS {side}_value"
        for side in ("source", "target")
    ]
    agrees = within_tolerance("source_value", "target_value", absolute, relative)
    return both.selectExpr("`column`", "function", *filled).selectExpr("*", f"{agrees} AS agrees")


def group_consistency(pair: Pair, by: list[str], columns: list[str], absolute: float) -> DataFrame:
    """(by..., column, source_rows, target_rows, source_sum, target_sum, agrees).

    One aggregate over both sides: a group present on one side only is an issue, null is a
    group, and only partial sums are shuffled. Decimal and integer sums are exact and held
    to ``absolute`` alone. A sum of doubles depends on the order of its terms, so there a
    difference below ``SUM_NOISE`` of the sum is no difference.
    """
    values = [f"{summable(quoted(c), pair.dtype(c))} AS __v{i}" for i, c in enumerate(columns)]
    aggs = {"source_rows": f"count_if({FROM_SOURCE})", "target_rows": f"count_if({FROM_TARGET})"}
    cells = []
    for i, c in enumerate(columns):
        for tag, side in (("s", FROM_SOURCE), ("t", FROM_TARGET)):
            aggs[f"__{tag}{i}"] = f"coalesce(sum(CASE WHEN {side} THEN __v{i} END), 0)"
        limit = f"{float(absolute)!r}D"
        if isinstance(pair.dtype(c), (T.DoubleType, T.StringType)):
            limit = f"greatest({limit}, {SUM_NOISE}D * greatest(abs(__s{i}), abs(__t{i})))"
        cells.append(
            struct(
                column=literal(c),
                source_sum=f"CAST(__s{i} AS double)",
                target_sum=f"CAST(__t{i} AS double)",
                agrees=f"source_rows > 0 AND target_rows > 0 AND CAST(abs(__s{i} - __t{i}) AS double) <= {limit}",
            )
        )
    grouped = aggregate(pair.tagged(*map(quoted, by), *values), by, aggs)
    return unpivot(grouped, [*map(quoted, by), "source_rows", "target_rows"], cells)


@dataclass(frozen=True)
class RuleOutcome:
    name: str
    source: Any = None
    target: Any = None
    error: str | None = None


def _as_aggregate(rule: Rule, df: DataFrame) -> Column | DataFrame | Any:
    if callable(rule.measure):
        return rule.measure(df)
    text = rule.measure.strip()
    if "{table}" in text:
        return df.sparkSession.sql(text, table=df)
    return F.expr(text)


def _scalar(df: DataFrame, wanted: Column | DataFrame | Any) -> Any:
    if isinstance(wanted, Column):
        return df.agg(wanted.alias("value")).first()[0]
    if isinstance(wanted, DataFrame):
        rows = wanted.limit(2).collect()
        if len(rows) > 1 or len(wanted.columns) != 1:
            raise ValueError(f"a rule has to give one value, this one gives {'several rows' if len(rows) > 1 else wanted.columns}")
        return rows[0][0] if rows else None
    return wanted


def rule_values(df: DataFrame, rules: list[Rule]) -> dict[str, Any]:
    """Each rule's scalar, or the exception it raised.

    All rules that are aggregates run in one job; if that job fails, each is run on its own
    so that one faulty rule takes no other with it.
    """
    out: dict[str, Any] = {}
    aggregates: dict[str, Column] = {}
    for rule in rules:
        try:
            wanted = _as_aggregate(rule, df)
            if isinstance(wanted, Column):
                df.agg(wanted)
                aggregates[rule.name] = wanted
            else:
                out[rule.name] = _scalar(df, wanted)
        except Exception as error:  # noqa: BLE001 - reported as the rule's outcome
            out[rule.name] = error
    if aggregates:
        try:
            row = df.agg(*[c.alias(f"r{i}") for i, c in enumerate(aggregates.values())]).first()
            out.update({name: row[i] for i, name in enumerate(aggregates)})
        except Exception:  # noqa: BLE001
            for name, c in aggregates.items():
                try:
                    out[name] = _scalar(df, c)
                except Exception as error:  # noqa: BLE001
                    out[name] = error
    return out


def rule_outcomes(source: DataFrame, target: DataFrame, rules: list[Rule]) -> list[RuleOutcome]:
    s, t = rule_values(source, rules), rule_values(target, rules)
    out = []
    for rule in rules:
        failed = [str(v) for v in (s[rule.name], t[rule.name]) if isinstance(v, Exception)]
        out.append(RuleOutcome(rule.name, error=failed[0]) if failed else RuleOutcome(rule.name, s[rule.name], t[rule.name]))
    return out




def custom_rules(source: DataFrame, target: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, source_value, target_value, agrees) for rules given as SQL aggregates, lazily:
    one aggregate a side and no intermediate result on the driver."""

    def one(df: DataFrame, is_source: bool) -> DataFrame:
        row = df.agg(*[_as_aggregate(r, df).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
        cells = [struct(rule=literal(r.name), tol=f"{float(r.margin)!r}D", value=f"r{i}") for i, r in enumerate(rules)]
        return unpivot(row, [f"{str(is_source).lower()} AS {IS_SOURCE}"], cells)

    both = both_sides(one(source, True).unionAll(one(target, False)), ["rule", "tol"], {"value": "value"})
    agrees = within_tolerance("source_value", "target_value", "tol", "tol")
    return both.selectExpr("rule", "source_value", "target_value", f"{agrees} AS agrees")
