"""Directory listing on whatever file system the session reads (local, HDFS, object store)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

SAFE_TABLE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, str(path))
    return fs.exists(p)


def list_csv(spark: SparkSession, directory: str) -> list[tuple[str, str]]:
    """(table name, path) of every ``*.csv`` file or part-file directory, sorted by name."""
    fs, p = _file_system(spark, str(directory))
    if not fs.exists(p):
        raise FileNotFoundError(f"no such directory: {directory}")
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p)]
    return sorted((name[: -len(".csv")], full) for name, full in names if name.endswith(".csv"))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, str(path))
    fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file or folder; the folders above ``to`` are made."""
    fs, p = _file_system(spark, path)
    _, target = _file_system(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"{path} could not be moved to {to}")


def children(spark: SparkSession, directory: str) -> list[str]:
    """Full names of what a folder holds, sorted; none if there is no such folder."""
    fs, p = _file_system(spark, directory)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def files_below(spark: SparkSession, paths: list[str]) -> list[list]:
    """[name, bytes, time of change] of every file under the paths, sorted; hidden ones and markers left out."""
    out = []
    for path in paths:
        fs, p = _file_system(spark, path)
        if not fs.exists(p):
            out.append([path, -1, -1])
            continue
        found = fs.listFiles(p, True)
        while found.hasNext():
            s = found.next()
            if not s.getPath().getName().startswith((".", "_")):
                out.append([s.getPath().toString(), s.getLen(), s.getModificationTime()])
    return sorted(out)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written under another name and renamed over an earlier one."""
    fs, p = _file_system(spark, path)
    _, beside = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(beside, p)


def read_small(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    held = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(held)).decode()
    finally:
        held.close()


def qualified(spark: SparkSession, path: str) -> str:
    """The one full name of a path, so that two spellings of a folder compare equal."""
    fs, p = _file_system(spark, str(path))
    return fs.makeQualified(p).toString().rstrip("/")


def require_safe_name(name: str) -> str:
    if not SAFE_TABLE_NAME.fullmatch(name):
        raise ValueError(f"not usable as a table name: {name!r}")
    return name
