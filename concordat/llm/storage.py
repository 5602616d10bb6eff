"""Files of our own format in a shared folder: written under temporary names, committed by a manifest.

A task writes each file under a name that no other attempt uses and reports it in a row. The rows of the attempts
that Spark took are stored first; then the files get their final names, and the list of these, written last,
is the manifest. Readers go by the manifest alone, so what a lost or repeated attempt leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame

from concordat.session import materialise

WRITTEN = "name string, temporary string, bytes long, records long, sha256 string"
_SCHEMA = pa.schema([("name", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the path inside it."""
    if local := re.fullmatch(r"(?:file:)?/*(/.*)", folder):
        return pafs.LocalFileSystem(), local[1]
    return pafs.FileSystem.from_uri(folder)


class Part:
    """One file being written."""

    def __init__(self, folder: str, name: str):
        self.fs, base = file_system(folder)
        self.name, self.temporary = name, f"_temporary/{uuid.uuid4().hex}"
        self.fs.create_dir(f"{base}/_temporary", recursive=True)
        self.stream = self.fs.open_output_stream(f"{base}/{self.temporary}", compression=None)
        self.digest, self.bytes, self.records = hashlib.sha256(), 0, 0

    def write(self, data: bytes, records: int = 1) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.bytes += len(data)
        self.records += records

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        held = (self.name, self.temporary, self.bytes, self.records, self.digest.hexdigest())
        return pa.record_batch([[x] for x in held], schema=_SCHEMA)


def spread(rows: DataFrame, *by: str, per_task: int) -> DataFrame:
    """Deal out few small rows that each stand for much work: at most ``per_task`` to a task, and fewer while cores are free.

    The number of tasks is given, as rows of some bytes would else be put together in one.
    """
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(n, 4 * cores), -(-n // per_task)), *by)


def commit(written: DataFrame, folder: str) -> DataFrame:
    """Run the writing tasks, give their files the final names, store and return the manifest."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for name, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # A repeated attempt finds the file moved already.
                if fs.get_file_info(f"{base}/{temporary}").type == pafs.FileType.File:
                    fs.move(f"{base}/{temporary}", f"{base}/{name}")
                elif fs.get_file_info(f"{base}/{name}").type != pafs.FileType.File:
                    raise FileNotFoundError(f"{folder}/{name}")
            yield batch

    held = materialise(written, "written")
    path = f"{folder}/_manifest"
    held.mapInArrow(rename, WRITTEN).select("name", "bytes", "records", "sha256").write.mode("error").parquet(path)
    return held.sparkSession.read.parquet(path)
