"""Making two extracts comparable: names, null tokens, white space, dates, numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from concordat.functions.cells import date_readings, is_integral, is_numeral, is_year, null_tokens_to_null, strip_text, to_datetime, to_number
from concordat.functions.names import normalise_names
from concordat.functions.sql import aggregate, literal, quoted, struct, unpivot

# Name parts that mark a column as a date, and as not to be read as a number; the least number
# of values that can make a date column, the shares that decide, and the years that count as such.
DATE_HINTS = ("date", "time", "timestamp", "_at")
TEMPORAL_HINTS = (*DATE_HINTS, "year")
MIN_DATE_SAMPLE = 20
MIN_DATE_SHARE = 0.8
MAX_YEAR_SHARE = 0.5
MIN_NUMBER_SHARE = 0.5
EVIDENCE = ("years", "dates", "numbers", "integers", "ambiguous")


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalise_names(df.columns))


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def unify_nulls_and_trim(df: DataFrame) -> DataFrame:
    """Null tokens become null and text is trimmed; expressions only, no pass of its own."""
    text = set(_text_columns(df))
    cleaned = lambda c: f"{strip_text(null_tokens_to_null(c))} AS {c}"
    return df.selectExpr(*[cleaned(quoted(c)) if c in text else quoted(c) for c in df.columns])


def _hinted(name: str, hints: tuple[str, ...]) -> bool:
    return any(h in name.lower() for h in hints)


def type_evidence(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """(column, is_text, filled, years, dates, numbers, integers, ambiguous, readings): how many non-null
    values of each text column (already trimmed) could be what. One pass for all columns.

    ``readings`` has the values read as dates by each of ``date_readings``; ``dates`` is the most of them. ``ambiguous`` counts
    values that two readings take for different days.
    """
    text, ways = _text_columns(df), date_readings(formats)
    if not text:
        names = ", ".join(f"{n} bigint" for n in ("filled", *EVIDENCE))
        return df.sparkSession.createDataFrame([], f"column string, is_text boolean, {names}, readings array<bigint>")
    # Each order is tried once per cell, in a projection of its own.
    orders = list(dict.fromkeys(o for way in ways for o in way))
    at = lambda i, o: quoted(f"{i}\n{o}")
    tried = df.selectExpr(*map(quoted, text), *[f"{to_datetime(quoted(c), formats, (o,))} AS {at(i, o)}" for i, c in enumerate(text) for o in orders])
    aggs, cells = {}, []
    for i, name in enumerate(text):
        c = quoted(name)
        read = [f"coalesce({', '.join(at(i, o) for o in way)})" for way in ways]
        found = {"years": is_year(c), "numbers": is_numeral(c), "integers": is_integral(c)}
        found |= {f"r{k}n": f"{r} IS NOT NULL" for k, r in enumerate(read)}
        apart = " OR ".join(f"{r} <> {read[0]}" for r in read[1:]) or "false"
        aggs |= {f"filled{i}": f"count({c})", f"ambiguous{i}": f"count_if({apart})"}
        aggs |= {f"{k}{i}": f"count_if({condition})" for k, condition in found.items()}
        readings = f"array({', '.join(f'r{k}n{i}' for k in range(len(ways)))})"
        counts = {k: f"{k}{i}" for k in ("filled", "years")} | {"dates": f"array_max({readings})"} | {k: f"{k}{i}" for k in EVIDENCE[2:]}
        cells.append(struct(column=literal(name), is_text="true", **counts, readings=readings))
    return unpivot(aggregate(tried, [], aggs), [], cells)


def type_decisions(evidence: DataFrame, min_date_sample: int = MIN_DATE_SAMPLE) -> DataFrame:
    """Adds ``becomes``: date, number or unchanged, from the counts of ``type_evidence``.

    A column with fewer than ``min_date_sample`` values is never read as dates.
    """
    hinted = lambda hints: "(" + " OR ".join(f"contains(lower(`column`), {literal(h)})" for h in hints) + ")"
    not_years = f"is_text AND years <= filled * {MAX_YEAR_SHARE}D"
    date = f"filled >= {min_date_sample} AND ({hinted(DATE_HINTS)} OR dates >= filled * {MIN_DATE_SHARE}D)"
    number = f"filled > 0 AND NOT {hinted(TEMPORAL_HINTS)} AND numbers >= filled * {MIN_NUMBER_SHARE}D"
    becomes = f"CASE WHEN {not_years} AND {date} THEN 'date' WHEN {not_years} AND {number} THEN 'number' ELSE 'unchanged' END"
    return evidence.selectExpr("*", f"{becomes} AS becomes")


@dataclass(frozen=True)
class Normalised:
    rows: DataFrame
    # column -> date | number, and how many non-null values the conversion turned to null
    converted: dict[str, str] = field(default_factory=dict)
    coerced_to_null: dict[str, int] = field(default_factory=dict)
    # date column -> the orders it was read in, and how many values another order would take for another day
    orders: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ambiguous: dict[str, int] = field(default_factory=dict)


def elect(readings: list[int], formats: list[str] | None = None, prefer: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """The one reading of a column: the one that reads most of its values; of equals ``prefer``, then the first."""
    ways = date_readings(formats)
    best = [w for w, n in zip(ways, readings) if n == max(readings)]
    return prefer if prefer in best else best[0]


def _in_doubt(row, formats: list[str] | None) -> bool:
    """Whether another reading takes as many of the values, and some of them for other days."""
    return row["ambiguous"] > 0 and row["readings"].count(max(row["readings"])) > 1


def infer_types(df: DataFrame, formats: list[str] | None = None) -> Normalised:
    """Trimmed text columns that hold dates or numbers get that type.

    All columns are judged by one aggregate over the table; the conversion itself is a
    projection. A date column is read in one order of day and month, the one that reads most values. What a conversion loses is
    counted, because a mixed column may lose up to half of its values.
    """
    rows = {r["column"]: r for r in type_decisions(type_evidence(df, formats)).collect() if r["becomes"] != "unchanged"}
    becomes = {c: _kind(r["becomes"], r["integers"] == r["numbers"]) for c, r in rows.items()}
    orders = {c: elect(r["readings"], formats) for c, r in rows.items() if r["becomes"] == "date"}
    doubtful = {c: rows[c]["ambiguous"] for c in orders if _in_doubt(rows[c], formats)}
    lost = {c: _lost(r, r["becomes"]) for c, r in rows.items()}
    return Normalised(_converted(df, becomes, formats, orders), {c: r["becomes"] for c, r in rows.items()}, lost, orders, doubtful)


def _kind(becomes: str, integral: bool) -> str:
    """Numbers that are all whole become longs, so that none is rounded."""
    return "bigint" if becomes == "number" and integral else "double" if becomes == "number" else becomes


def _lost(counts, becomes: str) -> int:
    """How many values a conversion would turn to null."""
    return counts["filled"] - counts["dates" if becomes == "date" else "numbers"]


def _converted(df: DataFrame, becomes: dict[str, str], formats: list[str] | None, orders: dict[str, tuple[str, ...]]) -> DataFrame:
    text = set(_text_columns(df))
    convert = lambda c: to_datetime(quoted(c), formats, orders.get(c)) if becomes[c] == "date" else to_number(quoted(c), becomes[c])
    return df.selectExpr(*[f"{convert(c)} AS {quoted(c)}" if c in becomes and c in text else quoted(c) for c in df.columns])


@dataclass(frozen=True)
class NormalisedPair:
    source: DataFrame
    target: DataFrame
    # column -> date | number
    converted: dict[str, str]
    # column -> how many values of the source and of the target the conversion would have turned to null
    kept_as_text: dict[str, tuple[int, int]]
    # date column -> the orders it was read in on each side
    orders: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)
    # date column -> values of each side that another order, which reads as many, would take for another day
    ambiguous: dict[str, tuple[int, int]] = field(default_factory=dict)


def normalise_pair(
    source: DataFrame, target: DataFrame, formats: list[str] | None = None, min_date_sample: int = MIN_DATE_SAMPLE
) -> NormalisedPair:
    """Both sides of a comparison, their types decided once over the values of both.

    A conversion that would lose a value on either side is not made: the texts are compared as they are, so
    no difference can hide behind a null. A side's dates are read in one order; if its own values leave open which, in
    the order of the other side.
    """
    source, target = (unify_nulls_and_trim(normalise_columns(df)) for df in (source, target))
    # One scan a side; the few figures of each column are added up here.
    own = [{r["column"]: r for r in type_evidence(df, formats).collect()} for df in (source, target)]
    spark = source.sparkSession
    sums = [(c, True, *(sum(e[c][n] for e in own if c in e) for n in ("filled", *EVIDENCE))) for c in dict.fromkeys([*own[0], *own[1]])]
    counted = spark.createDataFrame(sums, "column string, is_text boolean, " + ", ".join(f"{n} bigint" for n in ("filled", *EVIDENCE)))
    chosen = {r["column"]: r for r in type_decisions(counted, min_date_sample).collect() if r["becomes"] != "unchanged"}
    lost = {c: tuple(_lost(e[c], r["becomes"]) if c in e else 0 for e in own) for c, r in chosen.items()}
    kept = {c: n for c, n in lost.items() if any(n)}
    becomes = {c: _kind(r["becomes"], r["integers"] == r["numbers"]) for c, r in chosen.items() if c not in kept}
    orders, ambiguous = {}, {}
    for c in (c for c, b in becomes.items() if b == "date"):
        sides = [e.get(c) for e in own]
        sure = [elect(r["readings"], formats) for r in sides if r is not None and not _in_doubt(r, formats)]
        orders[c] = tuple(elect(r["readings"], formats, sure[0] if sure else None) if r is not None else date_readings(formats)[0] for r in sides)
        open_ = tuple(r["ambiguous"] if r is not None and _in_doubt(r, formats) else 0 for r in sides)
        if any(open_):
            ambiguous[c] = open_
    made = [_converted(df, becomes, formats, {c: o[i] for c, o in orders.items()}) for i, df in enumerate((source, target))]
    return NormalisedPair(*made, {c: chosen[c]["becomes"] for c in becomes}, kept, orders, ambiguous)


def normalise(df: DataFrame, formats: list[str] | None = None) -> Normalised:
    """Names, null tokens, white space, then types."""
    return infer_types(unify_nulls_and_trim(normalise_columns(df)), formats)
