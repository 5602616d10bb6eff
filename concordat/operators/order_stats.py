"""Global order without a global sort: exact percentiles and pairing by rank.

Values are cut into bins by bounds taken from a quantile sketch over both sides, whatever the distribution. Where one level of
``FAN`` bins leaves bins of more than twice ``rows_per_bin`` rows, these are cut again by bounds from sketches of their own, level
after level; a value that fills a bin alone ends it. A bin is a function of the value alone: a lost task recomputes to the same bin.
Equal values are folded to (value, count), which is what keeps a value held by a third of all rows from becoming one large task;
ranks are then a running sum of counts inside the bin plus the count of all lower bins.

No level reads the input. The ranking of all values folds them first, once, to a stored copy, and cuts that; percentiles count
the bins of the first level and then fold, store and cut only the bins that hold a wanted rank.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.numbers import absolute_diff, relative_diff
from concordat.functions.sql import aggregate, literal, quoted, struct, unpivot
from concordat.operators.pairing import FROM_SOURCE, FROM_TARGET, IS_SOURCE, Pair, as_doubles
from concordat.session import materialise

# Bins of the first level, whose bounds are plan text, and at most so many parts of a bin on each level below it.
FAN, SUB_FAN = 256, 64
# A part of a bin takes at least so many entries of the sketch that its bounds come from.
SKETCH_PER_PART, SMALLEST_SKETCH = 16, 1024
SKETCH_GROUPS = 512
RANKS_PER_BLOCK = 100_000
EXACT_IN_DOUBLE = 2**53


def percentile_name(p: float) -> str:
    return f"p{int(p * 100)}"


def count_rows(pair: Pair) -> int:
    """Rows of the longer side."""
    counts = aggregate(pair.tagged("1 AS one"), [IS_SOURCE], {"n": "count(1)"}).collect()
    return max((r["n"] for r in counts), default=0)


def _by_type(pair: Pair, columns: list[str]) -> list[list[str]]:
    """Columns that share a value type are worked on together, each type in its own exact
    arithmetic (a bigint or decimal is never squeezed into a double)."""
    groups: dict[T.DataType, list[str]] = {}
    for c in columns:
        groups.setdefault(pair.dtype(c), []).append(c)
    return list(groups.values())


def _finite(c: str) -> str:
    return f"CASE WHEN abs(CAST({c} AS double)) < double('infinity') THEN CAST({c} AS double) END"


def _first_look(pair: Pair, columns: list[str], n_bins: int) -> tuple[dict[str, list[float]], dict[str, int]]:
    """Bounds of ``n_bins`` bins of every column, and the largest absolute value of each bigint column, in one job.

    Sketches are merged in two steps, first those of the partitions that share one of ``SKETCH_GROUPS`` numbers, so
    the one task of the last step gets at most that many a column, however many partitions there are.
    """
    index = dict(enumerate(columns))
    longs = [i for i, c in index.items() if isinstance(pair.dtype(c), T.LongType)]
    cut = index if n_bins > 1 else {}
    if not cut and not longs:
        return {c: [] for c in columns}, {}
    accuracy = min(max(1024, 4 * n_bins), 65535)
    values = [f"{_finite(quoted(c))} AS v{i}" for i, c in cut.items()] + [f"CAST({quoted(index[i])} AS decimal(20,0)) AS x{i}" for i in longs]
    rows = pair.tagged(*values, f"pmod(spark_partition_id(), {SKETCH_GROUPS}) AS part")
    parts, merged = {}, {}
    for i in cut:
        parts |= {f"b{i}": f"kll_sketch_agg_double(v{i}, {accuracy})", f"n{i}": f"count(v{i})"}
        merged |= {f"b{i}": f"kll_merge_agg_double(CASE WHEN n{i} > 0 THEN b{i} END)", f"n{i}": f"sum(n{i})"}
    for i in longs:
        parts[f"m{i}"] = f"max(abs(x{i}))"
        merged[f"m{i}"] = f"max(m{i})"
    cuts = f"array({', '.join(f'{i / n_bins!r}D' for i in range(1, n_bins))})"
    read = [f"CASE WHEN n{i} > 0 THEN kll_sketch_get_quantile_double(b{i}, {cuts}) END AS b{i}" for i in cut]
    row = aggregate(aggregate(rows, ["part"], parts), [], merged).selectExpr(*read, *[f"m{i}" for i in longs]).first()
    return {c: sorted(set(row[f"b{i}"] or [])) if cut else [] for i, c in index.items()}, {index[i]: int(row[f"m{i}"] or 0) for i in longs}


def bin_bounds(pair: Pair, columns: list[str], n_bins: int) -> dict[str, list[float]]:
    """At most ``n_bins - 1`` ascending finite bounds per column: small, fixed-size driver state."""
    return _first_look(pair, columns, n_bins)[0] if n_bins > 1 else {c: [] for c in columns}


def _exact_in_doubles(pair: Pair, columns: list[str], largest: dict[str, int]) -> Pair:
    """Integers that a double holds exactly join the doubles, for one pass instead of two."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return as_doubles(pair, [c for c in columns if isinstance(pair.dtype(c), small) or largest.get(c, EXACT_IN_DOUBLE + 1) <= EXACT_IN_DOUBLE])


def _long(pair: Pair, columns: list[str], bounds: dict[str, list[float]]) -> DataFrame:
    """Rows (is_source, c, bin, v), nulls left out; ``c`` is the column's place in the list,
    a fraction of the bytes of its name in every shuffle that follows."""
    index = dict(enumerate(columns))
    wide = pair.tagged(*[f"{quoted(c)} AS v{i}" for i, c in index.items()])
    bins = {i: "0" for i in index}
    if any(bounds.values()):
        # The bin of an absent value is never looked at: the filter below drops the value.
        wide = wide.selectExpr("*", *[f"coalesce(CAST(v{i} AS double), 0D) AS k{i}" for i in index])
        splits = [[float("-inf"), *(bounds[c] or [0.0]), float("inf")] for c in columns]
        cut = Bucketizer(
            splitsArray=splits, inputCols=[f"k{i}" for i in index], outputCols=[f"bin{i}" for i in index]
        )
        wide, bins = cut.transform(wide), {i: f"CAST(bin{i} AS int)" for i in index}
    cells = [struct(c=str(i), bin=bins[i], v=f"v{i}") for i in index]
    return unpivot(wide, [IS_SOURCE], cells).where("v IS NOT NULL")


BIN = [IS_SOURCE, "c", "bin"]


def _name(columns: list[str]) -> str:
    return f"element_at(array({', '.join(map(literal, columns))}), c + 1) AS `column`"


def _runs(long: DataFrame) -> DataFrame:
    """Equal values folded to one row: (is_source, c, bin, v, n)."""
    return aggregate(long, [*BIN, "v"], {"n": "count(1)"})


def _bin_starts(rows: DataFrame, n: str = "count(1)") -> DataFrame:
    """(is_source, c, bin, bin_rows, bin_start, numbers) of values or (``n`` = sum(n)) of their runs. At most two
    rows per column and bin, so small by construction."""
    side = f"PARTITION BY {IS_SOURCE}, c"
    return aggregate(rows, BIN, {"bin_rows": n}).selectExpr(
        "*",
        f"coalesce(sum(bin_rows) OVER ({side} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bin_start",
        f"sum(bin_rows) OVER ({side}) AS numbers",
    )


def _ranked(runs: DataFrame) -> DataFrame:
    """Adds ``lo``: how many rows of the same bin come before this run."""
    within = f"PARTITION BY {IS_SOURCE}, c, bin ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return runs.selectExpr("*", f"coalesce(sum(n) OVER ({within}), 0) AS lo")


def _binned(pair: Pair, columns: list[str], rows: int, rows_per_bin: int, fan: int = 0) -> list[tuple[list[str], DataFrame]]:
    """(columns, runs of all values with their bins) of each value type. ``fan`` is for tests."""
    pair = _exact_in_doubles(pair, columns, _first_look(pair, columns, 1)[1])
    out = []
    for group in _by_type(pair, columns):
        runs = _runs(_long(pair, group, {}))
        out.append((group, _split_large(materialise(runs, "runs"), rows_per_bin, fan or FAN) if rows > rows_per_bin else runs))
    return out


def _split_large(runs: DataFrame, limit: int, fan: int) -> DataFrame:
    """Bins of more than twice ``limit`` runs with more than one value, cut again and again.

    A level reads the runs of the bins in question once, for their counts and sketches; the bounds it finds are a small
    stored table. Bin numbers grow by a factor of ``fan`` a level, so they keep the order of values.
    """
    suspects = None
    double = "CAST(v AS double)"
    others = [c for c in runs.columns if c != "bin"]
    while True:
        rows = runs if suspects is None else runs.join(F.broadcast(suspects), ["c", "bin"], "left_semi")
        sketch = f"kll_sketch_agg_double({_finite('v')}, {max(SKETCH_PER_PART * fan, SMALLEST_SKETCH)})"
        aggs = {"n": "count(1)", "low": f"min({double})", "high": f"max({double})", "sketch": sketch, "finite": f"count({_finite('v')})"}
        found = aggregate(rows, ["c", "bin"], aggs).where(f"n > {2 * limit} AND low < high AND finite > 0")
        cuts = lambda k: f"kll_sketch_get_quantile_double(sketch, array({', '.join(f'{i / k!r}D' for i in range(1, k))}))"
        steps = [k for k in (2, 4, 8, 16, 32, 64, 128) if k < fan] + [fan]
        whens = " ".join(f"WHEN n <= {k * limit} THEN {cuts(k)}" for k in steps[:-1])
        # The largest value is no bound, or a bin of few values would stay as it is.
        wanted = f"CASE {whens} ELSE {cuts(steps[-1])} END" if whens else cuts(steps[-1])
        bounds = f"array_distinct(filter({wanted}, b -> b < high))"
        split = materialise(found.selectExpr("c", "bin", f"CASE WHEN size({bounds}) > 0 THEN {bounds} ELSE array(low) END AS bounds"), "bin-bounds")
        if split.isEmpty():
            return runs
        # Never null, or filters for it would be pushed down through the halving and double it at every step.
        shift = f"coalesce(CAST(bin AS bigint), 0) * {fan}"
        suspects = split.selectExpr("c", f"explode(transform(sequence(0, size(bounds)), i -> {shift} + i)) AS bin")
        width = 1 << (fan - 1).bit_length()
        padded = f"concat(bounds, array_repeat(double('infinity'), {width - 1} - size(bounds))) AS bounds"
        cut = runs.join(F.broadcast(split.selectExpr("c", "bin", padded)), ["c", "bin"], "left").selectExpr("*", f"{double} AS d", "0 AS part")
        # How many bounds lie below the value, by halves; none where there are no bounds.
        for half in (width >> i for i in range(1, width.bit_length())):
            cut = cut.selectExpr(*runs.columns, "bounds", "d", f"part + IF(bounds[part + {half - 1}] < d, {half}, 0) AS part")
        runs = cut.selectExpr(*others, f"{shift} + part AS bin")
        fan = min(fan, SUB_FAN)


def column_percentiles(
    pair: Pair, columns: list[str], percentiles: list[float], rows_per_bin: int = 1_000_000, rows: int | None = None, fan: int = 0
) -> DataFrame:
    """Exact percentiles with linear interpolation: rows (is_source, column, stat, value).

    Only the bins that hold a wanted rank are read out: one counting pass that shuffles nothing but
    counts, and one pass filtered to those bins, which are cut further where they are large. (The built-in ``percentile`` keeps every
    distinct value of a group in one task's memory.)
    """
    if not columns or not percentiles:
        empty = f"`{IS_SOURCE}` boolean, column string, stat string, value double"
        return pair.source.sparkSession.createDataFrame([], empty)
    rows = count_rows(pair) if rows is None else rows
    n, fan = -(-rows // rows_per_bin), fan or FAN
    bounds, largest = _first_look(pair, columns, min(fan, n))
    pair = _exact_in_doubles(pair, columns, largest)
    parts = []
    for group in _by_type(pair, columns):
        # Up to one level the sketch's error bounds a bin by about twice its share; below that bins are counted.
        found = _percentiles_from_bins(_long(pair, group, bounds), percentiles, rows_per_bin if n > fan else 0, min(fan, SUB_FAN))
        parts.append(found.selectExpr(IS_SOURCE, _name(group), "stat", "value"))
    return reduce(DataFrame.unionAll, parts)


def _between(low: str, high: str, share: str) -> str:
    """Linear between two values; equal ones, infinite ones among them, are themselves."""
    return f"CASE WHEN {low} = {high} OR {share} = 0 THEN {low} ELSE {low} + ({high} - {low}) * {share} END"


def _percentiles_from_bins(long: DataFrame, percentiles: list[float], limit: int, fan: int) -> DataFrame:
    """``limit``: cut the wanted bins of more than twice so many runs; 0 leaves them as they are."""
    fractions = [struct(stat=literal(percentile_name(p)), p=f"{float(p)!r}D") for p in percentiles]
    ends = [struct(rank="floor(spot)", upper="false"), struct(rank="ceil(spot)", upper="true")]
    # For each side and column: the bins that hold rank floor(spot) and rank ceil(spot).
    spots = unpivot(_bin_starts(long), ["*"], fractions).selectExpr("*", "p * (numbers - 1) AS spot")
    wanted = (
        unpivot(spots, ["*"], ends)
        .where("rank >= bin_start AND rank < bin_start + bin_rows")
        .selectExpr(*BIN, "stat", "spot", "upper", "rank - bin_start AS k")
    )
    # Bounded: sides x columns x percentiles x 2 rows.
    wanted = materialise(wanted, "wanted-ranks") if limit else wanted
    runs = _runs(_in_bins(long, wanted))
    if limit:
        runs, wanted = _narrowed(runs, wanted, limit, fan)
    ranked = _ranked(runs)
    found = ranked.join(F.broadcast(wanted), BIN).where("k >= lo AND k < lo + n")
    ends_found = aggregate(
        found,
        [IS_SOURCE, "c", "stat"],
        {
            "low": "max(CASE WHEN NOT upper THEN CAST(v AS double) END)",
            "high": "max(CASE WHEN upper THEN CAST(v AS double) END)",
            "share": "max(spot - floor(spot))",
        },
    )
    return ends_found.selectExpr(IS_SOURCE, "c", "stat", f"{_between('low', 'high', 'share')} AS value")


def _in_bins(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(wanted.select(*BIN).distinct()), BIN, "left_semi")


def _narrowed(runs: DataFrame, wanted: DataFrame, limit: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """The parts of the wanted bins that hold a wanted rank, and the ranks within them."""
    cut = _split_large(materialise(runs.selectExpr("*", "bin AS home"), "wanted-bins"), limit, fan)
    home = [IS_SOURCE, "c", "home"]
    before = f"PARTITION BY {', '.join(home)} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    # At most two rows per wanted bin and part of it.
    parts = aggregate(cut, [*home, "bin"], {"part_rows": "sum(n)"}).selectExpr("*", f"coalesce(sum(part_rows) OVER ({before}), 0) AS part_start")
    inside = wanted.withColumnRenamed("bin", "home").join(parts, home).where("k >= part_start AND k < part_start + part_rows")
    wanted = materialise(inside.selectExpr(*BIN, "stat", "spot", "upper", "k - part_start AS k"), "wanted-ranks")
    return _in_bins(cut.drop("home"), wanted), wanted


# Non-null values per (is_source, column).
Numbers = dict[tuple[bool, str], int]


def rank_differences(
    pair: Pair,
    columns: list[str],
    rows_per_bin: int = 1_000_000,
    rows: int | None = None,
    ranks_per_block: int = RANKS_PER_BLOCK,
    percentiles: list[float] | None = None,
    numbers: Numbers | None = None,
    fan: int = 0,
) -> DataFrame:
    """Sort each side by value and compare the i-th with the i-th, for every column at once.

    Rows (column, source_count, target_count, max_absolute_diff, max_relative_diff); the
    differences are null where the counts differ. Runs of equal values are cut at block
    boundaries and the two sides meet inside a block of ranks, where a window carries the
    current value of either side forward: no join, no row per rank, and no block has more
    rows than twice ``ranks_per_block``.

    Where the counts of values are already known (``numbers``), exact ``percentiles`` come
    out of the same pass, as the arrays source_percentiles and target_percentiles.
    """
    spark = pair.source.sparkSession
    percentiles = percentiles if numbers else None
    extra = ["source_percentiles", "target_percentiles"] if percentiles else []
    if not columns:
        fields = ["column string", "source_count bigint", "target_count bigint"]
        fields += ["max_absolute_diff double", "max_relative_diff double", *[f"{e} array<double>" for e in extra]]
        return spark.createDataFrame([], ", ".join(fields))
    rows = count_rows(pair) if rows is None else rows
    parts = []
    for group, runs in _binned(pair, columns, rows, rows_per_bin, fan):
        # Two rows per column and bin at most.
        ranked = _ranked(runs).join(_bin_starts(runs, "sum(n)").select(*BIN, "bin_start"), BIN)
        spots = {}
        for tag, side in (("source", True), ("target", False)) if percentiles else ():
            spots[tag] = [[max(numbers.get((side, c), 0) - 1, 0) * p for c in group] for p in percentiles]
        found = _pair_by_rank(ranked.selectExpr(IS_SOURCE, "c", "v", "lo + bin_start AS lo", "n"), ranks_per_block, spots)
        parts.append(found.selectExpr("*", _name(group)).drop("c"))
    found = reduce(DataFrame.unionAll, parts)
    # A column without a value on either side has no row yet.
    named = spark.range(1).selectExpr(f"explode(array({', '.join(map(literal, columns))})) AS `column`")
    return named.join(found, "column", "left").selectExpr(
        "`column`",
        "coalesce(source_count, 0) AS source_count",
        "coalesce(target_count, 0) AS target_count",
        "max_absolute_diff",
        "max_relative_diff",
        *extra,
    )


def _pair_by_rank(ranked: DataFrame, block: int, spots: dict[str, list[list[float]]]) -> DataFrame:
    """``spots``: per side, per percentile, per column the (fractional) rank to read."""
    cut = ranked.selectExpr("*", f"lo DIV {block} AS first", f"(lo + n - 1) DIV {block} AS last")
    pieces = cut.selectExpr("*", "explode(sequence(first, last)) AS block").selectExpr(
        IS_SOURCE,
        "c",
        "block",
        f"greatest(lo, block * {block}) AS pos",
        "v",
        "lo",
        "n",
        # A run counts once, in the block it starts in.
        "block = first AS starts",
    )
    # RANGE, not ROWS: a position where both sides change sees both new values.
    upto = "PARTITION BY c, block ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    carried = pieces.selectExpr(
        "*",
        f"last(CASE WHEN {FROM_SOURCE} THEN v END, true) OVER ({upto}) AS s",
        f"last(CASE WHEN {FROM_TARGET} THEN v END, true) OVER ({upto}) AS t",
    )
    aggs = {
        "source_count": f"sum(CASE WHEN starts AND {FROM_SOURCE} THEN n ELSE 0 END)",
        "target_count": f"sum(CASE WHEN starts AND {FROM_TARGET} THEN n ELSE 0 END)",
        "worst": f"max({absolute_diff('s', 't')})",
        "worst_relative": f"max({relative_diff('s', 't')})",
    }
    arrays = []
    for tag, of_side in spots.items():
        side, values = FROM_SOURCE if tag == "source" else FROM_TARGET, []
        for j, per_column in enumerate(of_side):
            for end, rounded in (("low", math.floor), ("high", math.ceil)):
                rank = f"element_at(array({', '.join(f'{rounded(x)}L' for x in per_column)}), c + 1)"
                hit = f"{side} AND {rank} >= lo AND {rank} < lo + n"
                aggs[f"{tag}_{end}{j}"] = f"max(CASE WHEN {hit} THEN CAST(v AS double) END)"
            share = f"element_at(array({', '.join(f'{x - math.floor(x)!r}D' for x in per_column)}), c + 1)"
            values.append(_between(f"{tag}_low{j}", f"{tag}_high{j}", share))
        arrays.append(f"array({', '.join(values)}) AS {tag}_percentiles")
    return aggregate(carried, ["c"], aggs).selectExpr(
        "c",
        "source_count",
        "target_count",
        "CASE WHEN source_count = target_count THEN worst END AS max_absolute_diff",
        "CASE WHEN source_count = target_count THEN worst_relative END AS max_relative_diff",
        *arrays,
    )


# What a comparison under a key counts besides differences (see ``keyed_diff.key_differences``).
UNPAIRED = ("missing_in_target", "extra_in_target", "repeated_keys", "null_mismatches")


def exceeds_tolerance(differences: DataFrame, tolerances: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds abs_tolerance, rel_tolerance and ``exceeds``: different counts, either bound
    broken (both must hold here, unlike ``within_tolerance``), or keys or values without a partner."""

    def per_column(i: int) -> str:
        whens = " ".join(f"WHEN {literal(c)} THEN {float(t[i])!r}D" for c, t in tolerances.items())
        return f"CASE `column` {whens} END"

    broken = ["source_count <> target_count", "max_absolute_diff > abs_tolerance", "max_relative_diff > rel_tolerance"]
    broken += [f"{c} > 0" for c in UNPAIRED if c in differences.columns]
    limited = differences.selectExpr("*", f"{per_column(0)} AS abs_tolerance", f"{per_column(1)} AS rel_tolerance")
    return limited.selectExpr("*", f"coalesce({' OR '.join(broken)}, false) AS exceeds")
