"""Finding the rows that differ without moving the others: a tree of digests over ranges of the key's hash.

The rows of a side fall into nodes by the hash of their key. One scan gives each node's digest on both sides, which is a few numbers
per node and task. Only nodes whose digests differ are opened: their children are compared in the next scan, which leaves out the
rows of all other nodes before anything is shuffled. What is left at the end are the rows of the unequal nodes of the last level,
and only these are matched key by key.

Two tables of which one row in a million differs thus shuffle some thousand rows instead of all. Where differences are everywhere
(over ``MOST_UNEQUAL`` of the nodes) opening them settles nothing, and the levels end there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions.sql import aggregate
from concordat.operators import fingerprint
from concordat.operators.pairing import Pair
from concordat.session import materialise

FAN = 1024
#: The nodes of the last level are sent to every executor: a million numbers at most.
MOST_NODES = 1 << 20
FEW_ROWS = 1_000_000
MOST_UNEQUAL = 0.5
_NODE = "__node"


@dataclass(frozen=True)
class Level:
    """One level: its nodes, how many of those looked at differ, and the rows of both sides in these."""

    nodes: int
    unequal: int
    rows: int


@dataclass(frozen=True)
class Drilled:
    # The rows of both sides in the nodes that differ, and the way there.
    pair: Pair
    levels: list[Level]


def unequal_nodes(pair: Pair, key: list[str], nodes: int, kind: str = "fast") -> DataFrame:
    """(bucket, source_rows, target_rows) of the nodes whose digests differ."""
    partial = fingerprint.bucket_digests(pair, key, nodes, kind, columns=False)
    compared = fingerprint.compare_digests(fingerprint.bucket_checksums(partial), ["bucket"])
    return compared.where("NOT matches").select("bucket", "source_rows", "target_rows")


def _within(pair: Pair, key: list[str], nodes: int, kind: str, unequal: DataFrame) -> Pair:
    node = fingerprint.bucket_of(pair, key, nodes, kind)
    marks = F.broadcast(unequal.select(F.col("bucket").alias(_NODE)))
    some = lambda df: df.selectExpr("*", f"{node} AS {_NODE}").join(marks, _NODE, "left_semi").drop(_NODE)
    return Pair(some(pair.source), some(pair.target), pair.schema)


def drill_down(pair: Pair, key: list[str], fan: int = FAN, few_rows: int = FEW_ROWS, kind: str = "fast", levels: int = 2) -> Drilled:
    """Open unequal nodes level by level, until their rows are few, they are too many, or the levels are done."""
    found, nodes, narrowed = [], fan, pair
    for _ in range(levels):
        if nodes > MOST_NODES:
            break
        unequal = materialise(unequal_nodes(narrowed, key, nodes, kind), "nodes")
        sums = aggregate(unequal, [], {"n": "count(1)", "rows": "coalesce(sum(source_rows + target_rows), 0)"}).first()
        found.append(Level(nodes, sums["n"], sums["rows"]))
        # From the table itself: one test of the node replaces those of the levels above.
        narrowed = _within(pair, key, nodes, kind, unequal)
        if sums["rows"] <= few_rows or sums["n"] > MOST_UNEQUAL * nodes:
            break
        nodes *= fan
    return Drilled(narrowed, found)
