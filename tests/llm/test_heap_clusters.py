"""Clustering by popped bounds against full scans in plain Python."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.llm import heap_clusters
from concordat.llm.queries import QUERIES
from concordat.session import materialise

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(rows: list[tuple], k: int = 16, rounds: int = 3, dims: int = 64) -> Counter:
    vectors = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            vectors.append((i, [math.floor(64 * float(np.float32(x))) for x in e]))
    order = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        own = [min((apart(v, c), j) for j, c in enumerate(centroids)) for _, v in vectors]
        if r < rounds:
            for j in range(len(centroids)):
                members = [v for (_, v), (_, c) in zip(vectors, own) if c == j]
                if members:
                    centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    inertia = Counter()
    for d, j in own:
        inertia[j] += d
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), named[j]) for (i, _), (d, j) in zip(vectors, own))


def found(df) -> Counter:
    return Counter(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(QUERIES["op13_heap_clusters"](spark, sf_dir)) == by_hand(rows)


@pytest.mark.parametrize("seed, spread", [(1, 0.05), (2, 1.0), (3, 40.0)])
def test_clumps_copies_and_ties(spark, seed, spread):
    """Clumps, a third of all vectors equal, coarse components with many equal distances."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, 4)) * spread
    rows = [(i, (middles[i % 7] + rng.normal(size=4) * spread / 5).round(1 if spread > 1 else 3).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.25, -0.25, 0.0, 0.5]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for k, rounds in ((5, 3), (16, 6), (1, 2)):
        assert found(heap_clusters.cluster(df, k=k, rounds=rounds, dims=4)) == by_hand(rows, k, rounds, 4)


def test_few_vectors_expire(spark):
    """Far apart clumps: after the first rounds almost nothing is scanned again."""
    rng = np.random.default_rng(9)
    rows = [(i, (np.eye(8)[i % 8] * 50 + rng.normal(size=8)).tolist()) for i in range(800)]
    vectors = materialise(heap_clusters.kept_vectors(spark.createDataFrame(rows, SCHEMA), dims=8), "vectors")
    made = heap_clusters.Clustering(vectors, k=8, rounds=6)
    assert made.scanned[0] == 800 and made.scanned[-1] < 80
    assert made.assigned().count() == 800


ODD = [
    (1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [1.0, math.nan, 2.0]), (6, [math.inf, 1.0, 2.0]), (7, [1.0, 2.0, 3.0, 4.0]),
    (8, [0.0, -0.0, 1e-9]), (9, [-1e-9, 0.5, 0.5]), (9, [-1e-9, 0.5, 0.5]), (9, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0]), (None, [2.0, 1.0, 1.0]),
]


@pytest.mark.parametrize("k", [2, 16])
def test_odd_vectors(spark, k):
    df = spark.createDataFrame(ODD, SCHEMA)
    want = by_hand(ODD, k, 3, 3)
    assert sum(want.values()) == 6
    assert found(heap_clusters.cluster(df, k=k, dims=3)) == want
    more = df.select("*", *[F.lit("x").alias(n) for n in ("v", "cluster", "expiry", "was", "sign", "order", "Distance")])
    assert found(heap_clusters.cluster(more, k=k, dims=3)) == want
    doubles = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    assert found(heap_clusters.cluster(doubles, k=k, dims=3)) == want


def test_nothing_kept(spark):
    none = heap_clusters.cluster(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns[0] == "vec_id"
    assert heap_clusters.cluster(spark.createDataFrame(ODD[:7], SCHEMA), dims=3).collect() == []


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        heap_clusters.cluster(spark.createDataFrame([(1, [3e30, 0.0])], SCHEMA), dims=2).collect()
