"""Exact dedup in two passes over a blocked Bloom filter, in DataFrame functions alone.

Pass one hashes every text to a block of 32,768 bits and three places in it. A place that two or
more rows hit is set in the filter: only rows whose three places are all set can have an equal.
Pass two reads the texts again; rows that the filter clears pass straight through, and only the others
shuffle, keyed by the SHA-256 of the text, so the filter's mistakes cost a shuffle and change
nothing.

The filter grows by ``BITS_PER_ROW`` up to ``MAX_BLOCKS`` blocks of 4 KB, and never takes more than 64 MB on
an executor. Past some 30 million rows it lets more and more unique rows through to the shuffle; the
result stays exact.

A group may hold a third of all rows: groups are counted with partial sums, and what a group
decided goes back to its rows by a broadcast for groups with over a thousandth of the rows (so
fewer than a thousand of them) and by a join for the rest.

Defined results: a null text counts as empty and equals an empty one. Of equal texts the row with
the largest doc_id stays; a null doc_id is smaller than any. Rows with both in common are
repeats, of which one stays. An empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.session import materialise

BLOCK_BITS = 32_768
BITS_PER_ROW = 16
MAX_BLOCKS = 16_384
HEAVY = 1000


def _blocks(rows: int) -> int:
    return min(max(-(-rows * BITS_PER_ROW // BLOCK_BITS), 1), MAX_BLOCKS)


def _places(text: Column, blocks: int) -> tuple[Column, list[Column]]:
    hashed = F.xxhash64(text)
    again = F.xxhash64(hashed)
    at = [F.shiftrightunsigned(again, 15 * i).bitwiseAND(BLOCK_BITS - 1) for i in range(3)]
    return F.pmod(hashed, F.lit(blocks)), at


def repeated_filter(texts: DataFrame, text: Column, blocks: int) -> DataFrame:
    """(block, bits): the places of each block that at least two rows hit."""
    block, at = _places(text, blocks)
    hit = texts.select(block.alias("block"), F.explode(F.array_distinct(F.array(*at))).alias("at"))
    twice = hit.groupBy("block", "at").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return twice.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def _set_in(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.expr("1") == F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1))


def mark_possible(docs: DataFrame, flag: str) -> DataFrame:
    """``docs`` with a boolean column ``flag``: false where no other row can have the same text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blocks = _blocks(docs.count())
    bits = repeated_filter(docs, text, blocks).select(F.col("block").alias(f"{flag}_block"), F.col("bits").alias(f"{flag}_bits"))
    block, at = _places(text, blocks)
    found = docs.withColumn(f"{flag}_at", block).join(F.broadcast(bits), F.col(f"{flag}_at") == F.col(f"{flag}_block"), "left")
    held = F.col(f"{flag}_bits")
    possible = held.isNotNull() & _set_in(held, at[0]) & _set_in(held, at[1]) & _set_in(held, at[2])
    return found.withColumn(flag, possible).drop(f"{flag}_at", f"{flag}_block", f"{flag}_bits")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.count()
    marked = mark_possible(docs.select("doc_id", "text"), "maybe")
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    alone = marked.where("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha.alias("text_sha256")
    )
    shared = materialise(marked.where("maybe").select("doc_id", sha.alias("text_sha256")), "possible")
    groups = shared.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    heavy = groups.where(F.col("group_size") * HEAVY > rows)
    repeats = shared.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    first = repeats.join(F.broadcast(heavy), "text_sha256", "left")
    light = groups.where(F.col("group_size") * HEAVY <= rows)
    rest = first.where("group_size IS NULL").drop("keep_id", "group_size").join(light, "text_sha256")
    named = first.where("group_size IS NOT NULL").unionByName(rest).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return alone.unionByName(named.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.

    Of rows with one text and one doc_id, the one with the largest hash of the other columns stays.
    """
    columns = docs.columns
    flag, sha, rank = (_free(x, columns) for x in ("maybe", "sha", "rank"))
    marked = mark_possible(docs, flag)
    hashable = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    ordered = F.struct(F.col("doc_id"), F.xxhash64(*hashable))
    held = F.struct(*[F.col(f"`{c}`") for c in columns])
    shared = marked.where(F.col(flag)).groupBy(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias(sha))
    best = shared.agg(F.max_by(held, ordered).alias(rank)).select(f"{rank}.*")
    return marked.where(~F.col(flag)).drop(flag).unionByName(best)


def _free(name: str, taken: list[str]) -> str:
    """A column name that no given column begins with, whatever the case."""
    while any(c.lower().startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name
