"""Session-level helpers: the shared scratch folder and materialising a DataFrame."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from concordat.sources.paths import remove

CHECKPOINT_CONF = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (a
    single-machine test session) is a folder of our own made and remembered.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="concordat-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """The scratch copies that one piece of work made; they go with it, and nobody else's do."""

    def __init__(self, spark: SparkSession, around: Scratch | None = None):
        self.spark, self.around, self.paths, self._lock = spark, around, [], threading.Lock()

    def add(self, path: str) -> None:
        with self._lock:
            self.paths.append(path)
        if self.around:
            self.around.add(path)

    def _forget(self, gone: set[str]) -> None:
        with self._lock:
            self.paths = [p for p in self.paths if p not in gone]
        if self.around:
            self.around._forget(gone)

    def release(self, keep: DataFrame | None = None) -> None:
        """Delete the copies, but for the one that the materialised ``keep`` reads; those who read others are done with them."""
        with self._lock:
            gone = {p for p in self.paths if keep is None or p != _read_by(keep)}
        self._forget(gone)
        for path in gone:
            remove(self.spark, path)


_scope: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def _read_by(df: DataFrame) -> str | None:
    return getattr(df, "_scratch_path", None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Copies that are made inside the block belong to the scope it gives; what is left of them at the end stays until ``release``.

    Blocks may stand inside one another; the outer one also owns what the inner one left. Threads started inside take part if
    they run in a copy of the context (as ``plans.jobs`` does).
    """
    own = Scratch(spark, _scope.get())
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if (own := _scope.get()) is not None:
        own.add(path)
    return path


@contextmanager
def stored(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """The rows of ``df`` from a scratch copy that goes at the end of the block."""
    with scratch(df.sparkSession) as own:
        held = materialise(df, label)
    try:
        yield held
    finally:
        own.release()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back, so later jobs start from files."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("error").parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._scratch_path = path
    return held


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session that cannot import it.

    Nothing is sent where the workers find it on PYTHONPATH or in the working folder.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or root in {os.path.realpath(p) for p in paths if p}:
        return
    made = os.path.join(tempfile.mkdtemp(prefix="concordat-"), "concordat.zip")
    with zipfile.ZipFile(made, "w") as z:
        for folder, _, names in os.walk(os.path.dirname(os.path.abspath(__file__))):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(made)
    _shipped.add(app)
