"""Replacing stored outputs together: written beside their targets, then moved into place.

Everything a job writes goes to a staging folder next to where it shall stand. Once all of it is there, the moves that remain are
written down (the *intent*), and only then is anything that stands touched: the old goes aside, the new takes its
name. A job that fails before that leaves all targets as they were. One that dies amid the moves leaves its intent, and ``recover``
carries it to its end; each move may be repeated. What the new outputs replace is deleted last.

The ledger of a folder says which job made which path. A job overwrites and removes its own paths only: outputs of its last run that this
one no longer makes go after the new ones stand.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import SparkSession

from concordat.sources.paths import children, exists, move, qualified, read_small, remove, write_small

STAGING, LEDGER, INTENT = "_staging", "_made", "_intent"


def _parent(path: str) -> tuple[str, str]:
    folder, _, name = path.rstrip("/").rpartition("/")
    return folder, name


class Ledger:
    """Which job made which path, one small file per job in the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{LEDGER}"

    def owners(self) -> dict[str, str]:
        """path -> job."""
        out = {}
        for file in children(self.spark, self.folder):
            if file.endswith(".json"):
                held = json.loads(read_small(self.spark, file))
                out |= {path: held["job"] for path in held["paths"]}
        return out

    def paths(self, job: str) -> set[str]:
        return {path for path, owner in self.owners().items() if owner == job}

    def write(self, job: str, paths: list[str]) -> None:
        write_small(self.spark, f"{self.folder}/{job}.json", json.dumps({"job": job, "paths": sorted(paths)}))


def job_of(paths: list[str]) -> str:
    """A name for whoever writes these paths, for writers that have none: others' commits in the folder are not theirs."""
    return "paths-" + hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Staged:
    """One commit: ask for a place for each target, write there, then ``commit``."""

    def __init__(self, spark: SparkSession, folder: str, job: str):
        self.spark, self.folder, self.job = spark, folder.rstrip("/"), job
        self.id = f"{job}-{time.time_ns():020d}-{uuid.uuid4().hex}"
        self.moves: list[dict[str, str]] = []

    def place(self, final: str) -> str:
        """Where to write what shall stand at ``final``: on the same file system, so that it can be moved."""
        final = qualified(self.spark, final)
        parent, name = _parent(final)
        place = f"{parent}/{STAGING}/{self.id}"
        self.moves.append({"staged": f"{place}/new-{name}", "final": final, "old": f"{place}/old-{name}"})
        return self.moves[-1]["staged"]

    def commit(self, ledger: bool = False) -> None:
        """Move everything into place. With ``ledger`` the folder remembers the paths as this job's, and its stale ones go."""
        lost = [m["final"] for m in self.moves if not exists(self.spark, m["staged"])]
        if lost:
            raise FileNotFoundError(f"these outputs were never written: {lost}")
        stale = []
        if ledger:
            finals = {m["final"] for m in self.moves}
            stale = sorted(Ledger(self.spark, self.folder).paths(self.job) - finals)
        intent = {"job": self.job, "folder": self.folder, "moves": self.moves, "stale": stale, "ledger": ledger}
        at = f"{self.folder}/{STAGING}/{self.id}/{INTENT}"
        write_small(self.spark, at, json.dumps(intent))
        _carry_out(self.spark, intent)

    def discard(self) -> None:
        """Forget what was written so far; the targets were not touched."""
        for folder in {_parent(m["staged"])[0] for m in self.moves} | {f"{self.folder}/{STAGING}/{self.id}"}:
            remove(self.spark, folder)

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is not None and not exists(self.spark, f"{self.folder}/{STAGING}/{self.id}/{INTENT}"):
            self.discard()


def _carry_out(spark: SparkSession, intent: dict) -> None:
    for m in intent["moves"]:
        if exists(spark, m["staged"]):
            if exists(spark, m["final"]):
                remove(spark, m["old"])
                move(spark, m["final"], m["old"])
            move(spark, m["staged"], m["final"])
    if intent["ledger"]:
        Ledger(spark, intent["folder"]).write(intent["job"], [m["final"] for m in intent["moves"]])
    for path in intent["stale"]:
        remove(spark, path)
    own = f"{intent['folder']}/{STAGING}"
    # The folder with the intent goes last.
    for folder in sorted({_parent(m["staged"])[0] for m in intent["moves"]}, key=lambda f: f.startswith(own)):
        remove(spark, folder)
    for folder in children(spark, own):
        if exists(spark, f"{folder}/{INTENT}") and json.loads(read_small(spark, f"{folder}/{INTENT}")) == intent:
            remove(spark, folder)


def recover(spark: SparkSession, folder: str, job: str) -> int:
    """Carry this job's interrupted commits in ``folder`` to their end and drop what never came to one; how many were carried."""
    done = 0
    for left in children(spark, f"{folder.rstrip('/')}/{STAGING}"):
        # A commit is named by job, time and a random number; those of other jobs may be under way.
        if left.rsplit("/", 1)[1].rsplit("-", 2)[0] != job:
            continue
        if exists(spark, f"{left}/{INTENT}"):
            _carry_out(spark, json.loads(read_small(spark, f"{left}/{INTENT}")))
            done += 1
        else:
            remove(spark, left)
    return done
