"""Quality classifier: ordinal regression with a cumulative link on hashed text.

A text has graded ratings 0 (toxic), 1 (poor), 2 (good). One weight vector over hashed features is
shared by all grades, ordered thresholds cut its score: P(grade <= j) = sigmoid(threshold_j - score).
The tail probability P(grade = 2) selects, the expected grade ranks.

Features, hashed to ``BUCKETS`` and each taken once per text: the runs of letters and digits (A-Z lower-cased), their
beginnings, the runs of other marks, and in tenths the share of words equal to the one before, of capitals, and of
runs of marks. The fit is proximal gradient descent with an L1 penalty, so words without a part in the
ratings weigh nothing however long a text is; a bucket in fewer than ``LEAST_TEXTS`` texts is left out. It uses at most ``MAX_TRAIN`` labelled texts, those with the
smallest hash of doc_id; every document is scored on its whole text.

Defined results: a null or empty text has no features and gets the score 0, so its grade follows the
thresholds. Labels without a document, or with a null in a rating, are not used; a document with several labels
counts once for each. Without labels every document is kept, with null figures. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm import bytewise

BUCKETS = 1 << 18
MAX_TRAIN = 10_000
PENALTY = 2e-4
STEPS = 500
LEAST_TEXTS = 3
KEEP_AT = 0.5
BEGINNINGS = (4, 5)

_KIND = np.full(256, 2, np.uint8)
_KIND[bytewise.SEPARATOR] = 0
_KIND[128:] = 1
for _first, _last in (b"09", b"AZ", b"az"):
    _KIND[_first : _last + 1] = 1

_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets, how many per text): the different buckets of each text."""
    for first, end, data, at in bytewise.pieces(column):
        kind, rows = _KIND[data], end - first
        starts, ends, owners = bytewise.spans(kind == 1, at)
        words = bytewise.span_hashes(data, starts, ends, lower=True)
        hashes, of = [words], [owners]
        for n in BEGINNINGS:
            long = ends - starts > n
            hashes.append(bytewise.mix(bytewise.span_hashes(data, starts[long], starts[long] + n, lower=True) + np.uint64(n)))
            of.append(owners[long])
        starts, ends, marks_of = bytewise.spans(kind == 2, at)
        hashes.append(bytewise.span_hashes(data, starts, ends))
        of.append(marks_of)
        n_words = np.bincount(owners, minlength=rows)
        again = np.bincount(owners[1:][(words[1:] == words[:-1]) & (owners[1:] == owners[:-1])], minlength=rows)
        shapes = ((again, n_words), (bytewise.per_text(_CAPITAL[data], at), bytewise.per_text(kind == 1, at)), (np.bincount(marks_of, minlength=rows), n_words))
        for i, (part, whole) in enumerate(shapes):
            tenth = 10 * np.minimum(part, whole) // np.maximum(whole, 1)
            hashes.append(bytewise.mix((100 * (i + 1) + tenth).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            of.append(np.arange(rows))
        packed = (np.concatenate(of).astype(np.uint64) << np.uint64(18)) | (np.concatenate(hashes) >> np.uint64(46))
        packed = packed[(at[1:] > at[:-1])[(packed >> np.uint64(18)).astype(np.int64)]]
        packed = np.unique(packed)
        yield first, (packed & np.uint64(BUCKETS - 1)).astype(np.int32), np.bincount((packed >> np.uint64(18)).astype(np.int64), minlength=rows)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(bucket: np.ndarray, count: np.ndarray, grade: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Accelerated proximal gradient on the mean log-likelihood of the grades; the thresholds are not penalised."""
    n, levels = len(count), 3
    common = (np.bincount(bucket, minlength=BUCKETS) >= LEAST_TEXTS)[bucket]
    of = np.repeat(np.arange(n), count)[common]
    bucket = bucket[common].astype(np.int64)
    share = np.array([(grade > j).mean() for j in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    w, theta = np.zeros(BUCKETS), np.log((1 - share) / share)
    w_ahead, theta_ahead, momentum = w, theta, 1.0
    # The curvature of the likelihood is at most half of the largest eigenvalue of X'X / n.
    v = np.ones(n)
    for _ in range(20):
        v = np.bincount(of, np.bincount(bucket, v[of], BUCKETS)[bucket], n)
        size = np.linalg.norm(v)
        v /= size
    step = 1.0 / (0.5 * (size / n) + 0.5)
    low, high = grade > 0, grade < levels - 1
    for _ in range(steps):
        score = np.bincount(of, w_ahead[bucket], n)
        bounds = np.concatenate([[-np.inf], theta_ahead, [np.inf]])
        above, below = bounds[grade + 1] - score, bounds[grade] - score
        p_above, p_below = 1 / (1 + np.exp(-np.clip(above, -40, 40))), 1 / (1 + np.exp(-np.clip(below, -40, 40)))
        p_above, p_below = np.where(high, p_above, 1.0), np.where(low, p_below, 0.0)
        likely = np.maximum(p_above - p_below, 1e-9)
        d_above = np.where(high, p_above * (1 - p_above), 0) / likely
        d_below = np.where(low, p_below * (1 - p_below), 0) / likely
        slope = (d_above - d_below) / n  # of the loss by the score
        grad = np.bincount(bucket, slope[of], BUCKETS)
        by_theta = np.array([(d_below[grade == j + 1].sum() - d_above[grade == j].sum()) / n for j in range(levels - 1)])
        moved = w_ahead - step * grad
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_theta = np.maximum.accumulate(theta_ahead - step * by_theta + 1e-6 * np.arange(levels - 1))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push = (momentum - 1) / faster
        w_ahead, theta_ahead = new_w + push * (new_w - w), np.sort(new_theta + push * (new_theta - theta))
        w, theta, momentum = new_w, new_theta, faster
    return Model(w.astype(np.float32), theta)


def grade_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 1, 2).otherwise(1)


def _to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, bucket, count in features(batch.column(2)):
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(bucket))
            yield pa.record_batch([batch.column(0)[first : first + len(count)].cast(pa.int64()), batch.column(1)[first : first + len(count)], lists], ["doc_id", "grade", "buckets"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """Fit on the bounded sample; only hashed features of its texts reach the driver."""
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    rated = rated.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).cast("int").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_train)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")
    rows = texts.mapInArrow(bytewise.tidy(_to_features), "doc_id long, grade int, buckets array<int>").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    lists, grade = rows["buckets"].combine_chunks(), rows["grade"].to_numpy().astype(np.int64)
    del rows
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return fit(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), grade)


def score(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: doc_id, score, expected_grade, p_good, kept."""
    if model is None:
        empty = [F.lit(None).cast("double").alias(c) for c in ("score", "expected_grade", "p_good")]
        return docs.select("doc_id", *empty, F.lit(True).alias("kept"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for first, bucket, count in features(batch.column(1)):
                total = np.bincount(np.repeat(np.arange(len(count)), count), model.weights[bucket], len(count)).astype(float)
                tails = model.tails(total)
                ids = batch.column(0)[first : first + len(count)].cast(pa.int64())
                yield pa.record_batch([ids, *map(pa.array, (total, tails.sum(1), tails[:, -1], tails[:, -1] >= keep_at))], ["doc_id", "score", "expected_grade", "p_good", "kept"])

    return docs.select("doc_id", "text").mapInArrow(bytewise.tidy(run), "doc_id long, score double, expected_grade double, p_good double, kept boolean")


def select_good(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all columns, without a shuffle."""
    if model is None:
        return docs
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            good = []
            for _, bucket, count in features(batch.column(place)):
                total = np.bincount(np.repeat(np.arange(len(count)), count), model.weights[bucket], len(count)).astype(float)
                good.append(model.tails(total)[:, -1] >= keep_at)
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(bytewise.tidy(run), docs.schema)
