"""Centroid clustering with heap-ordered bounds: exact Lloyd rounds that rescan only vectors whose bound gave out.

A scanned vector has a gap: its distance to the second nearest centroid less that to its own. When centroids move, the gap
shrinks by no more than its own centroid's move and the largest move of another. The sum of these since the start is
the cluster's drift; a vector is filed under gap + drift at the time (its *expiry*), so nothing has to be rewritten as
centroids move: while the drift is below the expiry, the vector's nearest centroid is known without looking at it.

*Heaps.* Each scan writes its vectors once, as a generation of files in which those of a cluster stand in order of
expiry. Such a sorted run is a heap, and popping what expires is reading a range of it: the range of (cluster, expiry)
is pushed down to Parquet, whose row groups and page indexes skip the rest. A vector that is popped is scanned against
all centroids and filed in the next generation. Which rows of an older generation still count follows from the drifts alone.
So a round reads and writes as many vectors as expire, not as many as there are. Sums of clusters are
carried on, with the vectors that changed cluster added and taken away.

Components are integers and distances exact 64-bit integers; only gaps and drifts are doubles, each rounded to the safe side. Of
equally near centroids the smaller number wins (a gap of 0 expires at every round). A cluster may hold any share of the vectors:
nothing is grouped by cluster but partial sums.

Defined results: a vector is kept if it has exactly ``dims`` components, none null or non-finite; others, and null vectors, give
no row. Repeated rows are vectors each. A null vec_id is carried, and is taken for a first centroid after all others;
equal ids are taken by components. With fewer vectors than centroids each vector starts one. An empty table gives no rows.
A component beyond 2^26 / ``scale`` in size is an error, as squared distances would not fit 64 bits. An inertia that does not fit 64
bits is null. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.session import materialise

CENTROIDS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
LARGEST = 1 << 26
ROWS = 4096  # scanned at a time
_SAFE = 1e-12

Centroids = list[list[int]]


def kept_vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that count, in integers."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False)))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = F.forall("embedding", lambda x: F.abs(x.cast("double")) * scale <= LARGEST)
    v = F.when(fits, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>"))
    counts = F.coalesce((F.size("embedding") == dims) & finite, F.lit(False))
    return embeddings.select("vec_id", "embedding").where(counts).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> Centroids:
    """The vectors with the smallest SHA-256 of ``1:<vec_id>``, in that order."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    top = vectors.select(order.alias("order"), "v").orderBy(F.col("order").asc_nulls_last(), "v").limit(k)
    return [list(r["v"]) for r in top.collect()]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vector, centroid), exact."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for at in range(0, len(x), ROWS):
        some = x[at : at + ROWS].astype(np.int64)
        for j, c in enumerate(centroids):
            apart = some - c
            out[at : at + ROWS, j] = np.einsum("ij,ij->i", apart, apart)
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


_FILED = "vec_id long, v array<int>, cluster int, expiry double, was int"


def _scan(centroids: Centroids, drift: list[float]):
    """File vectors (vec_id, v, was) under the nearest centroid and their expiry."""
    at, moved, dims = np.array(centroids, np.int64), np.array(drift), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(_matrix(batch.column(1), dims), at)
            cluster = d.argmin(1)
            gap = np.full(len(d), math.inf)
            if len(at) > 1:
                two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(float))
                gap = two[:, 1] * (1 - _SAFE) - two[:, 0] * (1 + _SAFE)
            expiry = gap + moved[cluster]
            columns = [*batch.columns[:2], pa.array(cluster, pa.int32()), pa.array(expiry), batch.column(2)]
            yield pa.record_batch(columns, ["vec_id", "v", "cluster", "expiry", "was"])

    return run


def _filed(vectors: DataFrame, centroids: Centroids, drift: list[float], label: str) -> DataFrame:
    """One generation: scanned and stored, each cluster in order of expiry within a file."""
    scanned = vectors.mapInArrow(_scan(centroids, drift), _FILED)
    return materialise(scanned.sortWithinPartitions("cluster", "expiry"), label)


def _sums(signed: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, sums by component) of rows (cluster, sign, v)."""
    sums = [F.sum(F.col("sign") * F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dims)]
    return {r[0]: (r[1], list(r[2:])) for r in signed.groupBy("cluster").agg(F.sum("sign"), *sums).collect()}


def _limits(drift: list[float]) -> list[float]:
    """Expiries up to these are popped: the drift and what rounding may have taken from it."""
    return [d * (1 + 1e-9) + 1e-9 for d in drift]


def _between(low: list[float] | None, high: list[float] | None) -> Column:
    """Rows whose expiry lies over ``low`` and up to ``high`` of their cluster."""
    out = F.lit(False)
    for c in range(len(low or high)):
        held = F.col("cluster") == c
        if low:
            held &= F.col("expiry") > low[c]
        if high:
            held &= F.col("expiry") <= high[c]
        out |= held
    return out


def _moved(old: Centroids, new: Centroids, drift: list[float]) -> list[float]:
    """The drifts after the centroids went from ``old`` to ``new``."""
    move = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) * (1 + _SAFE) for x, y in zip(old, new)]
    return [d + move[c] + max((m for j, m in enumerate(move) if j != c), default=0.0) for c, d in enumerate(drift)]


class Clustering:
    """Centroids and the generations of filed vectors, after ``rounds`` rounds and the assignment that follows them."""

    def __init__(self, vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS):
        self.centroids = first_centroids(vectors, k)
        self.scanned: list[int] = []  # vectors scanned at each assignment
        if not self.centroids:
            self.generations = []
            return
        dims, n = len(self.centroids[0]), len(self.centroids)
        drift = [0.0] * n
        limits = [_limits(drift)]
        first = _filed(vectors.select("vec_id", "v", F.lit(None).cast("int").alias("was")), self.centroids, drift, "filed")
        self.generations = [first]
        held = {c: (0, [0] * dims) for c in range(n)}
        changes = first.select("cluster", F.lit(1).cast("long").alias("sign"), "v")
        for r in range(rounds):
            for c, (count, sums) in _sums(changes, dims).items():
                held[c] = held[c][0] + count, [a + b for a, b in zip(held[c][1], sums)]
            if not r:
                self.scanned.append(sum(count for count, _ in held.values()))
            new = [[s // held[c][0] for s in held[c][1]] if held[c][0] else self.centroids[c] for c in range(n)]
            drift = _moved(self.centroids, new, drift)
            self.centroids = new
            limits.append(_limits(drift))
            popped = None
            for g, filed in enumerate(self.generations):
                # What an earlier round popped has its place in a later generation.
                low = limits[r] if g < r else None
                some = filed.where(_between(low, limits[r + 1])).select("vec_id", "v", F.col("cluster").alias("was"))
                popped = some if popped is None else popped.unionByName(some)
            again = _filed(popped, self.centroids, drift, "filed")
            self.generations.append(again)
            self.scanned.append(again.count())
            gone = F.array(F.struct(F.col("cluster"), F.lit(1).cast("long").alias("sign")), F.struct(F.col("was").alias("cluster"), F.lit(-1).cast("long").alias("sign")))
            changes = again.where("cluster <> was").select(F.explode(gone).alias("g"), "v").select("g.cluster", "g.sign", "v")
        self.limits = limits

    def assigned(self) -> DataFrame:
        """(vec_id, cluster, distance) of every vector, the distance squared and exact."""
        out, last = None, len(self.generations) - 1
        for g, filed in enumerate(self.generations):
            some = (filed if g == last else filed.where(_between(self.limits[last], None))).select("vec_id", "v", "cluster")
            out = some if out is None else out.unionByName(some)
        at, dims = np.array(self.centroids, np.int64), len(self.centroids[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    apart = _matrix(batch.column(1), dims).astype(np.int64) - at[batch.column(2).to_numpy()]
                    yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.einsum("ij,ij->i", apart, apart))], ["vec_id", "cluster", "distance"])

        return out.mapInArrow(run, "vec_id long, cluster int, distance long")


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    made = Clustering(kept_vectors(embeddings, dims, scale), k, rounds)
    if not made.centroids:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    rows = materialise(made.assigned(), "clustered")
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")
    of = {r["cluster"]: int(r["inertia"]) for r in rows.groupBy("cluster").agg(exact).collect()}
    long = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in made.centroids]
    pairs = [x for c, n in of.items() for x in (F.lit(c), F.struct(long(n).alias("i"), F.lit(digest[c]).alias("d")))]
    own = F.element_at(F.create_map(*pairs), F.col("cluster"))
    return rows.select("vec_id", "cluster", "distance", own["i"].alias("cluster_inertia"), long(sum(of.values())).alias("inertia"), own["d"].alias("centroid_sha256"))
