"""WARC: a deterministic sharded writer and its reader.

Pages are cut into shards by ranges of page_id of about equal bytes; the ranges come from exact byte totals by
id, refined where many ids lie close, so the same table gives the same files. Each shard is sorted by id and
written record by record, each record a gzip member of its own; a new file begins when the compressed size of
one passes a limit. Headers, record ids and digests are made anew. Files are committed by a manifest (``storage``).

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the smallest page_id is a
response and the others are revisits that refer to it.

Defined results: a null html is an empty payload, a null url an empty target. Null ids come after all others, in
order of digest. Rows with one id and one payload are one response (or revisit) and revisits of the same id. An
empty table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from decimal import Decimal
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm import storage
from concordat.llm.skew import join_groups
from concordat.session import materialise, scratch_path

LEAST_REVISIT = 100
FILE_BYTES = 16 << 20
SHARD_BYTES = 32 << 20
RECORD_BYTES = 600  # headers of a record, for the size of shards
BINS, LEAST_BINS = 4096, 256
FILES_PER_TASK = 16
DATE = "2024-01-01T00:00:00Z"
# Fixed value: the profile of a revisit in the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f3f2c1e-6a53-4d0a-9a5e-8a4f3f1d7c55")


def _record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}/{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id, digest, copy),
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Page-ID": "" if page_id is None else str(page_id),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to, digest, 0), "WARC-Refers-To-Page-ID": "" if refers_to is None else str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream, one at a time."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("a record ends in its headers")
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield head, block


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """First ids of the shards after the first, from stored (page_id, size): ranges of about ``shard_bytes``.

    Ids are counted in equal bins, at most ``BINS``; those with more than a shard are counted again in finer ones, all of a level in one job. A
    level has some four bins for each shard its bins hold (``LEAST_BINS`` at least), and only those with records reach the driver.
    """
    sizes = sizes.where("page_id IS NOT NULL")
    whole = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum(F.col("size") + RECORD_BYTES)).first()
    if whole[0] is None:
        return np.zeros(0, np.int64)
    lowest, width, fullest = whole[0], whole[1] - whole[0] + 1, whole[2]
    exact = lambda x: F.lit(x).cast("decimal(38,0)")
    away = F.col("page_id").cast("decimal(38,0)") - exact(lowest)
    totals: list[tuple[int, int]] = []
    inside, marks = away, None  # the place inside the bin of the last level
    while True:
        width = (width - 1) // min(BINS, max(LEAST_BINS, 4 * (fullest // shard_bytes + 1))) + 1
        deeper = inside % exact(width)
        rows = sizes.select((away - inside).cast("decimal(38,0)").alias("parent"), (away - deeper).cast("decimal(38,0)").alias("start"), (F.col("size") + RECORD_BYTES).alias("size"))
        if marks is not None:
            rows = rows.join(F.broadcast(marks), "parent", "left_semi")
        found = [(int(start), total) for start, total in rows.groupBy("start").agg(F.sum("size")).collect()]
        heavy = [(start, total) for start, total in found if total > shard_bytes and width > 1]
        totals += [x for x in found if x[1] <= shard_bytes or width == 1]
        if not heavy:
            break
        inside, fullest = deeper, max(total for _, total in heavy)
        marks = sizes.sparkSession.createDataFrame([(Decimal(start),) for start, _ in heavy], "parent decimal(38,0)")
    bounds, held = [], 0
    for start, total in sorted(totals):
        if held and held + total > shard_bytes:
            bounds.append(lowest + start)
            held = 0
        held += total
    return np.array(bounds, np.int64)


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, number = None, None, 0
        mark: tuple | None = None  # (page_id, digest) that is a revisit, and of what
        last: tuple | None = None
        copy = 0
        for batch in batches:
            for s, page_id, digest, is_mark, first_id, url, html in zip(*(batch.column(i) for i in range(7))):
                s, page_id, digest = s.as_py(), page_id.as_py(), digest.as_py()
                if is_mark.as_py():
                    mark = (page_id, digest, first_id.as_py())
                    continue
                if s != shard and part is not None:
                    yield part.close()
                    part = None
                if s != shard:
                    shard, number = s, 0
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                copy = copy + 1 if (page_id, digest) == last else 0
                last = (page_id, digest)
                refers, revisit = None, False
                if len(payload) >= LEAST_REVISIT:
                    if mark is not None and mark[:2] == last:
                        refers = mark[2]
                        revisit = refers != page_id or copy > 0
                if part is None:
                    part = storage.Part(folder, f"part-{shard:06d}-{number:05d}.warc.gz")
                    number += 1
                part.write(gzip.compress(record(page_id, url.as_py(), payload, digest, copy, refers, revisit), 6, mtime=0))
                if part.bytes >= file_bytes:
                    yield part.close()
                    part = None
        if part is not None:
            yield part.close()

    return run


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``; the manifest is returned."""
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha2(html.cast("binary"), 256)
    known = materialise(pages.select("page_id", digest.alias("digest"), F.octet_length(html).cast("long").alias("size")), "payloads")
    bounds = shard_bounds(known, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, page_id.to_numpy(), "right").astype("int32"))

    long = known.where(F.col("size") >= LEAST_REVISIT)
    groups = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = join_groups(long.select("page_id", "digest").distinct(), groups, "digest", "n", known.count())
    marks = marks.select("page_id", "digest", F.lit(True).alias("is_mark"), "first_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    rows = pages.select("page_id", digest.alias("digest"), F.lit(False).alias("is_mark"), F.lit(None).cast("long").alias("first_id"), "url", "html")
    dealt = rows.unionByName(marks)
    # A null would turn the ids of its batch into floats. Records without an id stand in shards of their own, dealt by payload.
    unnamed = known.where("page_id IS NULL").agg(F.sum(F.col("size") + RECORD_BYTES)).first()[0] or 0
    more = -(-unnamed // shard_bytes)
    without = len(bounds) + 1 + F.pmod(F.xxhash64("digest"), F.lit(max(1, more))).cast("int")
    at = F.when(F.col("page_id").isNull(), without).otherwise(shard_of(F.coalesce("page_id", F.lit(0).cast("long"))))
    dealt = dealt.withColumn("shard", at)
    dealt = dealt.select("shard", "page_id", "digest", "is_mark", "first_id", "url", "html")
    order = [F.col("shard"), F.col("page_id").asc_nulls_last(), F.col("digest"), F.col("is_mark").desc(), F.col("url")]
    written = dealt.repartitionById(len(bounds) + 1 + more, "shard").sortWithinPartitions(*order).mapInArrow(_writer(folder, file_bytes), storage.WRITTEN)
    return storage.commit(written, folder)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives: page_id, record_type, payload_bytes, payload_digest, refers_to, url, payload.

    Digests are made anew from what is read and have to agree with the headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = storage.file_system(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in parse(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"] == "revisit"
                        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"{name}: block digest")
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: payload digest")
                        size = int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
                        ids = [int(v) if (v := head.get(k)) else None for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")]
                        rows.append((ids[0], head["WARC-Type"], size, digest, ids[1], head["WARC-Target-URI"], None if revisit else payload))
                        held += len(payload)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"
    return storage.spread(manifest.select("name"), "name", per_task=FILES_PER_TASK).mapInArrow(run, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a scratch folder and read the records back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)
