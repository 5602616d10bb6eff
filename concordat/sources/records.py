"""Records of delimited files with the place each begins, read by many tasks whatever the quoting.

A line break inside quotes does not end a record, and whether a place in a file is inside quotes depends on everything before it.
So quotes are counted first, split by split (a *split* is the byte range of a file that one task reads): the sums of the splits
before one say whether it begins inside quotes, and the sums of their bytes at which byte its first line begins. With these two
numbers every split is cut into records by itself. A record that runs over the end of a split is left as fragments, at most
two a split, and stitched by file and order. Only the figures of splits and the fragments are shuffled, never the lines.

A doubled quote inside a quoted field counts twice and changes nothing. Lines end in ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.session import materialise

QUOTE = '"'
#: A record over so many bytes is taken for a quote that was never closed.
MOST_RECORD_BYTES = 64 << 20

_CUT = "file string, split long, kind string, byte_offset long, record string"
WHOLE, HEAD, TAIL = "whole", "head", "tail"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line): every line, in order within a split; ``split`` is the byte where the split begins."""
    text = spark.read.option("lineSep", "\n").text(str(path))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def split_figures(found: DataFrame, multiline: bool = True, one_byte: bool = False) -> DataFrame:
    """(file, split, first_byte, inside): where the first line of each split begins, and if it does so inside quotes."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit(QUOTE), F.lit("")))
    size = F.length("line") if one_byte else F.octet_length("line")
    sums = found.groupBy("file", "split").agg(F.sum(size + 1).alias("bytes"), F.sum(quotes if multiline else F.lit(0)).alias("quotes"))
    # One row per split: a file's rows are its size over some hundred megabytes.
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long")
    return sums.select("file", "split", before("bytes").alias("first_byte"), (before("quotes") % 2).cast("int").alias("inside"))


def _cutter(multiline: bool, one_byte: bool):
    """Lines with the figures of their split, split after split, to records and fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None  # (file, split) being read
        at = inside = 0
        opened: tuple[str, int, list[str]] | None = None  # kind, first byte and lines of a record under way

        def closed(kind: str) -> tuple:
            return (*here, kind, opened[1], "\n".join(opened[2]))

        for batch in batches:
            out: list[tuple] = []
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if keys[a] != here:
                    if opened:
                        out.append(closed(opened[0] if opened[0] == HEAD else TAIL))
                    here, at, inside, opened = keys[a], part.column(2)[0].as_py(), part.column(3)[0].as_py(), None
                    if inside:
                        opened = (HEAD, at, [])
                column = part.column(4)
                size = (pc.utf8_length if one_byte else pc.binary_length)(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                starts = at + np.cumsum(size) - size
                at += int(size.sum())
                odd = np.zeros(len(size), np.int64)
                if multiline:
                    odd = pc.count_substring(column, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64) & 1
                after = (inside + np.cumsum(odd)) & 1
                before = np.concatenate([[inside], after[:-1]])
                inside = int(after[-1])
                alone = (before == 0) & (after == 0)
                if alone.any():
                    keep = pa.array(alone)
                    n = int(alone.sum())
                    kept = [pa.array([here[0]] * n), pa.array([here[1]] * n, pa.int64()), pa.array([WHOLE] * n), pa.array(starts[alone]), column.filter(keep)]
                    yield pa.record_batch(kept, ["file", "split", "kind", "byte_offset", "record"])
                for i in np.flatnonzero(~alone).tolist():
                    text = column[i].as_py()
                    if opened is None:
                        opened = (WHOLE, int(starts[i]), [text])
                        continue
                    opened[2].append(text)
                    if not after[i]:
                        out.append(closed(opened[0]))
                        opened = None
            if out:
                yield _batch(out)
        if opened:
            yield _batch([closed(opened[0] if opened[0] == HEAD else TAIL)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "split", "kind", "byte_offset", "record"])


def _stitched(fragments: DataFrame) -> DataFrame:
    """Whole records from what splits left over: a tail, and the heads of the splits after it."""
    order = Window.partitionBy("file").orderBy("split", "byte_offset").rowsBetween(Window.unboundedPreceding, 0)
    numbered = fragments.withColumn("number", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("split", "byte_offset", "record")))
    # Sizes come first: what a quote that never closes swallows is not put together.
    size = F.sum(F.octet_length("record")).over(Window.partitionBy("file", "number"))
    checked = numbered.withColumn("bytes", size).where(
        F.when(F.col("bytes") <= MOST_RECORD_BYTES, True).otherwise(
            F.raise_error(F.concat(F.lit("a quote is not closed in "), F.col("file"), F.lit(" from byte "), F.col("byte_offset").cast("string"))).cast("boolean")
        )
    )
    joined = checked.groupBy("file", "number").agg(F.min("byte_offset").alias("byte_offset"), pieces.alias("pieces"))
    return joined.select("file", "byte_offset", F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"))


def records(spark: SparkSession, path: str, multiline: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """(file, byte_offset, record): every record but headers (a file's first) and blank lines, without its line end.

    With ``multiline`` a record may hold line breaks inside quotes; else each line is one.
    """
    found, utf8 = lines(spark, path), encoding.upper().replace("-", "") == "UTF8"
    if not utf8:
        if encoding.upper().startswith(("UTF-16", "UTF-32", "UTF16", "UTF32")):
            raise ValueError(f"{encoding} does not write line ends and quotes as single bytes")
        # Each byte is a character until records are cut.
        found = found.withColumn("line", F.decode(F.col("line").cast("binary"), "ISO-8859-1"))
    figures = materialise(split_figures(found, multiline, not utf8), "splits")
    placed = found.join(figures, ["file", "split"], "left")
    lost = F.raise_error(F.lit("the splits of a file changed between two readings")).cast("long")
    placed = placed.select("file", "split", F.coalesce("first_byte", lost).alias("first_byte"), "inside", "line")
    cut = placed.mapInArrow(_cutter(multiline, not utf8), _CUT)
    whole = cut.where(F.col("kind") == WHOLE).select("file", "byte_offset", "record")
    if multiline:
        whole = whole.unionByName(_stitched(cut.where(F.col("kind") != WHOLE)))
    if not utf8:
        whole = whole.withColumn("record", F.decode(F.encode("record", "ISO-8859-1"), encoding))
    filled = F.col("record").rlike("[^\\x00-\\x20]")
    no_header = F.raise_error(F.concat(F.col("file"), F.lit(" begins with a blank line, not with a header"))).cast("boolean")
    kept = F.when(F.col("byte_offset") > 0, filled).when(filled, False).otherwise(no_header)
    return whole.withColumn("record", F.regexp_replace("record", "\r$", "")).where(kept)
