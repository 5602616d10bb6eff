"""Token counts by a separator scan of flat token files.

Token files have 16-bit ids one after the other, each document followed by an end-of-document id, and no
index. They are read in blocks of a fixed size, wherever these begin; a block's separators are found by one
vectorised comparison. Documents that lie inside a block are counted there. Those that run over its edges are
stitched by a prefix scan over a file's blocks: the last separator before a block tells where its first document
began, and how many there were before numbers its documents. Tokens after the last separator of a file are a
document that was not closed.

``write`` makes such files from texts, and a list of which document is where in which file (the scan
itself never sees it).

Defined results: a null or empty text has no ids, so its count is 0. Repeated rows are counted each, null doc_ids
carried. An empty table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from concordat.llm import packing, storage
from concordat.session import materialise, scratch_path

END_OF_DOCUMENT = 50_256
FILE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
BLOCKS_PER_TASK = 64
WIDTH = 2  # bytes of an id


def _writer(folder: str, tokenizer: str, ranks: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = packing.encoder(tokenizer, ranks), TaskContext.get().partitionId()
        part, number, ids = None, 0, []

        def closed() -> pa.RecordBatch:
            done = part.close()
            return pa.record_batch([*done.columns, pa.array([ids], pa.list_(pa.int64()))], [*done.schema.names, "doc_ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part is None:
                    part, ids = storage.Part(folder, f"tokens-{task:06d}-{number:05d}.u16"), []
                    number += 1
                part.write(np.append(encode(text.as_py() or ""), np.uint32(END_OF_DOCUMENT)).astype("<u2").tobytes())
                ids.append(doc_id)
                if part.bytes >= file_bytes:
                    yield closed()
                    part = None
        if part is not None:
            yield closed()

    return run


def write(docs: DataFrame, folder: str, file_bytes: int = FILE_BYTES, tokenizer: str | None = None, ranks: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, places): the token files of all texts, and (name, ordinal, doc_id) of every document."""
    tokenizer, ranks = tokenizer or public_tokenizers.path(packing.TOKENIZER), ranks or public_tokenizers.path(packing.RANKS)
    made = docs.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, ranks, file_bytes), storage.WRITTEN + ", doc_ids array<long>")
    held = materialise(made, "token-files")
    places = held.select("name", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    return storage.commit(held.drop("doc_ids"), folder), places


def _blocks(folder: str, separator: int):
    """(name, block, first token, tokens, places of separators in the file) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = storage.file_system(folder)
        for batch in batches:
            for name, block, begin, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
                with fs.open_input_file(f"{base}/{name}") as f:
                    ids = np.frombuffer(f.read_at(size, begin), "<u2")
                if len(ids) * WIDTH != size:
                    raise ValueError(f"{name} is shorter than its manifest says")
                ends = np.flatnonzero(ids == separator) + begin // WIDTH
                yield pa.record_batch([[name], [block], [begin // WIDTH + len(ids)], pa.array([ends], pa.list_(pa.int64()))], ["name", "block", "upto", "ends"])

    return run


def scan(files: DataFrame, folder: str, separator: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(name, ordinal, start, n_tokens, closed) of each document in the files (name, bytes)."""
    block_bytes -= block_bytes % WIDTH
    whole = files.select("name", F.expr(f"bytes - bytes % {WIDTH}").alias("bytes")).where("bytes > 0")
    n = F.ceil(F.col("bytes") / block_bytes).cast("long")
    todo = whole.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    todo = todo.select("name", "block", (F.col("block") * block_bytes).alias("begin"), F.least(F.lit(block_bytes), F.col("bytes") - F.col("block") * block_bytes).cast("long").alias("size"))
    found = materialise(storage.spread(todo, "name", "block", per_task=BLOCKS_PER_TASK).mapInArrow(_blocks(folder, separator), "name string, block long, upto long, ends array<long>"), "separators")

    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edges = found.select("name", "block", "upto", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    carried = edges.select(
        "name", "block",
        (F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1).cast("long")) + 1).alias("start"),
        F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("earlier"),
    )
    inside = found.select("name", "block", F.posexplode("ends").alias("i", "end"), F.col("ends").alias("held"))
    inside = inside.select("name", "block", "i", "end", F.when(F.col("i") > 0, F.expr("try_element_at(held, i)") + 1).alias("own"))
    closed = inside.join(carried, ["name", "block"]).select(
        "name", (F.col("earlier") + F.col("i")).alias("ordinal"), F.coalesce("own", "start").alias("start"),
        (F.col("end") - F.coalesce("own", "start")).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    tail = edges.groupBy("name").agg(F.sum("n").cast("long").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1).cast("long")) + 1).alias("start"), F.max("upto").alias("upto"))
    tail = tail.where("upto > start").select("name", "ordinal", "start", (F.col("upto") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def counts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, file, start, from token files made of the texts."""
    folder = scratch_path(docs.sparkSession, "tokens")
    manifest, places = write(docs, folder)
    found = scan(manifest, folder)
    return places.join(found, ["name", "ordinal"]).select("doc_id", "n_tokens", F.col("name").alias("file"), "start")
