"""Independent Spark jobs of one comparison, submitted together so that the cluster is not
idle while a small one finishes."""

from __future__ import annotations

import time
from concurrent.futures import Future, ThreadPoolExecutor
from contextvars import copy_context
from typing import Any


class Jobs:
    def __init__(self, at_once: int = 4):
        self._pool = ThreadPoolExecutor(at_once, thread_name_prefix="checks")
        self._running: dict[str, Future] = {}

    def start(self, name: str, work, *args) -> None:
        def timed() -> tuple[Any, float]:
            began = time.perf_counter()
            value = work(*args)
            return value, (time.perf_counter() - began) * 1000

        # In a copy of the context, so that scratch copies belong to whoever started the jobs.
        self._running[name] = self._pool.submit(copy_context().run, timed)

    def result(self, name: str) -> tuple[Any, float]:
        """The job's value and its duration in ms; raises what the job raised."""
        return self._running[name].result()

    def alike(self, columns: list[str]) -> tuple[bool, list[str]]:
        """What the digests already settle: whether all rows agree, and which columns hold
        the same values on both sides. Such columns cannot differ by rank, in their distinct
        counts or in their percentiles, and such tables not under any key, so the heavier
        jobs look at one side or not at all. Nothing is settled where no digests were taken.
        Waits for the digests, which must have been started first.
        """
        if "digests" not in self._running:
            return False, []
        digests, _ = self.result("digests")
        return digests["table"]["all"]["matches"], [c for c in columns if digests["column"][c]["matches"]]

    def __enter__(self) -> "Jobs":
        return self

    def __exit__(self, *_: object) -> None:
        self._pool.shutdown(wait=True)
