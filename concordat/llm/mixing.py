"""Mixing sources to target weights along a time-varying curriculum.

A source has a weight schedule: the weight at the points of a time axis from 0 (first step of training)
to 1 (last), straight between them. Its integral, as a share of the source's target, is the demand
that has built up by a time. The words of a source stand one after the other in a fixed random order of its
documents, again and again until the target is met; a word's place in that line, as a share of the
target, is put through the inverse of the demand, which gives its training position. Documents are sorted by range of
position.

The lines are laid in two steps, so no task holds a source: sizes are summed by (source, range of
the order hash), the sums of the ranges are added up, and only inside a range are
documents put in order. The number of ranges follows the number of rows.

Targets: sources by code point, null last, take weights from a repeating list and share a given part of all
sizes; a target over ``most`` times its source's size is cut to that, and the excess goes to the others by
weight until none is above.

A source's target ends inside one pass over one document: ``mix`` emits that text up to the last word that the
target covers, so the words it emits of a document are its ``taken`` and those of a source its rounded target.

Defined results: a null or wordless text has size 0, is taken 0 words and stands nowhere. Null sources
are one source. Rows with one doc_id and one text are different documents that may change places with one
another. No rows, or no words at all, give targets of 0. Other columns are carried by ``mix`` and may have any name
but those it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.session import materialise, scratch

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: (time, weight) of each kind of source: early, level and late.
SCHEDULES = (((0.0, 3.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.6, 0.5), (1.0, 4.0)))
ROWS_PER_RANGE = 20_000
WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*" + WORD


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, place, weight, target), one row per source.

    Water is poured over the sources by weight: those with the least room for their weight fill up
    first, so with sources in that order one running sum tells which are full.
    """
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    held = held.withColumn("place", place).withColumn("weight", weight).withColumn("room", F.col("source_size") * F.lit(float(most)))
    line = Window.orderBy(F.col("room") / F.col("weight"), "place")
    full = F.coalesce(F.sum("room").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    wanted = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    held = held.withColumn("level", (wanted - full) / left).withColumn("room_at", F.row_number().over(line))
    fits = F.col("level") * F.col("weight") < F.col("room")
    first = F.min(F.when(fits, F.struct("room_at", "level"))).over(Window.partitionBy())["level"]
    held = held.withColumn("first", first)
    target = F.when(F.col("first").isNull(), F.col("room")).otherwise(F.least("room", F.col("first") * F.col("weight")))
    return held.select("source", "source_size", "place", "weight", target.alias("target"))


def order_hash(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit("mix"), doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def lines(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text, source, size) as (doc_id, source, size, order, before)."""
    ranges = max(1, -(-documents.count() // ROWS_PER_RANGE))
    part = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * ranges).cast("int")
    laid = documents.select("doc_id", "source", "size", order_hash(F.col("doc_id"), F.col("text")).alias("order"))
    laid = materialise(laid.withColumn("part", part), "line")
    sums = laid.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), "base")
    inside = Window.partitionBy("source", "part").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = laid.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = within.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return joined.select("doc_id", "source", "size", "order", (F.col("base") + F.col("inside")).alias("before"))


def demand_time(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """The time at which a schedule has asked for ``share`` (0 to 1) of all that it will ask for."""
    out = None
    for k, points in enumerate(schedules):
        total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(points, points[1:]))
        done, time = 0.0, None
        for (t0, w0), (t1, w1) in zip(points, points[1:]):
            piece = (t1 - t0) * (w0 + w1) / 2
            need, slope = share * F.lit(total) - F.lit(done), (w1 - w0) / (t1 - t0)
            # Area of a trapezium from t0: w0 x + slope x^2 / 2 = need; written so that slope 0 works.
            x = F.lit(2.0) * need / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * need, F.lit(0.0))))
            here = F.lit(t0) + x
            last = (t1, w1) == points[-1]
            time = (time if time is not None else F).when(share * F.lit(total) <= F.lit(done + piece), here) if not last else (time.otherwise(here) if time is not None else here)
            done += piece
        out = (out if out is not None else F).when(kind == k, time)
    return out


def taken_words(lines_: DataFrame, targets: DataFrame) -> DataFrame:
    """Lines and targets with ``passes``: the words of each pass that fall before the target."""
    t = F.broadcast(targets) if targets.count() <= 100_000 else targets
    t = t.withColumnRenamed("source", "t_source")
    both = lines_.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    end = F.round("target").cast("long")
    once = lambda begin: F.least(F.greatest(end - begin, F.lit(0)), F.col("size"))
    return both.withColumn("passes", F.array(once(F.col("before")), once(F.col("before") + F.col("source_size"))))


def mixture(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, order, positions.

    ``positions`` has (at, words) of each pass over the document of which words are taken: its training position
    (0 to 1) and how many.
    """
    sized = documents.select("doc_id", "text", "source", word_count(F.col("text")).alias("size"))
    laid = materialise(lines(sized), "laid")
    both = taken_words(laid, source_targets(laid))

    def position(n: int) -> Column:
        share = (F.col("before") + n * F.col("source_size")) / F.greatest("target", F.lit(1.0))
        here = demand_time(F.least(share, F.lit(1.0)), F.col("place") % len(SCHEDULES))
        words = F.col("passes")[n]
        return F.when(words > 0, F.struct(here.alias("at"), words.alias("words")))

    positions = F.array_compact(F.array(position(0), position(1))).alias("positions")
    return both.select("doc_id", "size", "source_size", "target", (F.col("passes")[0] + F.col("passes")[1]).alias("taken"), "order", positions)


def _sorted_by_position(documents: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """(order, copy, at, words, row): ``columns`` of ``documents`` once for each pass of the rows of ``mixture`` in ``wanted``.

    Documents and passes meet in one shuffle by order, the n-th of each in the same hash (its ``copy``), so whole
    texts move once before the sort.
    """
    wanted = wanted.where(F.size("positions") > 0).select("order", "positions")
    order = order_hash(F.col("doc_id"), F.col("text")).alias("order")
    full = documents.select(order, F.lit(None).cast(wanted.schema["positions"].dataType).alias("positions"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    both = full.unionByName(wanted.withColumn("row", F.lit(None).cast(full.schema["row"].dataType)))
    both = both.repartition("order").withColumn("copy", F.row_number().over(Window.partitionBy("order", F.col("row").isNull()).orderBy("positions")))
    # Before the n-th document stands the n-th row of passes, if there is one, else another document.
    line = Window.partitionBy("order").orderBy("copy", F.col("row").isNotNull())
    both = both.withColumn("positions", F.lag("positions").over(line)).where("row IS NOT NULL")
    both = both.select("order", "copy", "row", F.explode("positions").alias("pass")).select("order", "copy", "pass.at", "pass.words", "row")
    text = F.col("row.text")
    both = both.withColumn("row", F.col("row").withField("text", F.when(F.col("words") < word_count(text), first_words(text, F.col("words"))).otherwise(text)))
    return both.repartitionByRange("at", "order").sortWithinPartitions("at", "order")


def mix(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` once for each pass, sorted by training position.

    Texts are whole but for the one in which a source's target ends; other columns are carried as they are.
    """
    return _sorted_by_position(documents, mixture(documents), documents.columns).select(*[F.col(f"row.`{c}`") for c in documents.columns])


def emitted(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken; ``taken`` is counted in the texts that the sorted mix emits."""
    with scratch(documents.sparkSession) as first:
        wanted = materialise(mixture(documents), "wanted")
    first.release(keep=wanted)
    rows = _sorted_by_position(documents, wanted, ["text"])
    # Stored, as a sort below a sum would be dropped.
    rows = materialise(rows.select("order", "copy", "at", word_count(F.col("row.text")).alias("words")), "mixed")
    taken = rows.groupBy("order", "copy").agg(F.sum("words").alias("taken"))
    copy = F.when(F.size("positions") > 0, F.row_number().over(Window.partitionBy("order", F.size("positions") > 0).orderBy("positions")))
    held = wanted.drop("taken").withColumn("copy", copy)
    return held.join(taken, ["order", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
