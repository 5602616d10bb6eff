"""Ranked lexical search over hashed max-sketches.

A document's impact for a term is what the term adds to a score but for the term's weight: it grows with the term's occurrences and
falls with the document's length. Its sketch is an array of bytes, a power of two of them and at least ``ROOM`` for
each of its distinct terms; a term's hash names a coordinate, which keeps the maximum of the impacts that fall on it, rounded up to one of
255 levels. So a coordinate is never below the impact of any term of the document, and the sum of weights times
coordinates over the terms of a query is an upper bound of its score. Sketches do not depend on the queries; a long text has a long one.

*Search.* Queries are taken in blocks of at most ``BLOCK_TERMS`` terms. A block is looked up in all sketches at once, and
each query's ``FIRST`` highest bounds are found, from heaps kept by each task. Their documents are scored exactly, which gives each query a threshold: its
``top``-th best score so far. A second look-up keeps the (query, document) pairs with bounds at or above the threshold. They are
rescored in descending order of bound, in slabs that grow by ``GROWTH``; each slab raises the thresholds, and when no pair
is left at or above its threshold, no other document can be among the best. Equal scores count as above, because the smaller doc_id
decides. A document is scored once, for all queries of the block.

Nothing is capped: a query whose threshold stays low (or is missing, when fewer documents share a term with it)
has all its pairs rescored. Thresholds, weights and the ``top`` rows of each query are all that the driver holds of a block.
Documents are told apart by a hash of id and text; two with one hash are rescored together, which costs time, not results. Terms are
compared by 64-bit hashes: among ``d`` distinct terms one of ``t`` query terms is mistaken with odds d*t/2^64.

Defined results: a null or termless text is no document and ranks nowhere; a query without terms, or whose terms no
document holds, has no rows. Repeated rows are documents (or queries) each. A null doc_id ranks after other ids
of the same score, a null item_id is carried. Empty tables give no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.llm import bytewise
from concordat.session import materialise

TOP = 10
FIRST = 16
GROWTH = 32
ROOM = 4
BLOCK_TERMS = 1 << 16
BROADCAST_BYTES = 32 << 20
KEY_BYTES = 32  # of a hashed key in a broadcast table
LEVELS, MOST = 255, 1_000_000  # impacts are below MOST
CELLS = 1 << 21  # (term, document) cells looked up at a time
HELD = 1 << 16  # scores kept before they are cut down to the best

_MEMBER = np.zeros(256, bool)
_MEMBER[128:] = True
for _first, _last in ("09", "AZ", "az"):
    _MEMBER[ord(_first) : ord(_last) + 1] = True


def term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, terms of each row, and row, term and occurrences of each distinct pair)."""
    for first, end, data, at in bytewise.pieces(column):
        starts, ends, owners = bytewise.spans(_MEMBER[data], at)
        terms = bytewise.span_hashes(data, starts, ends, lower=True)
        order = np.lexsort((terms, owners))
        terms, owners = terms[order], owners[order]
        begins = np.ones(len(terms), bool)
        begins[1:] = (terms[1:] != terms[:-1]) | (owners[1:] != owners[:-1])
        begins = np.flatnonzero(begins)
        yield first, end, np.bincount(owners, minlength=end - first), owners[begins], terms[begins], np.diff(np.append(begins, len(terms)))


@dataclass
class Collection:
    """What a score needs of all documents: how many have terms, and all their terms."""

    documents: int
    terms: int

    def length(self, n: np.ndarray) -> np.ndarray:
        """A document's m, in Python's integers as the product may be large."""
        return np.array([25 + 75 * x * self.documents // self.terms for x in n.tolist()], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Block:
    """Queries that are looked up together: their items and (query, term, times) entries, by query."""

    items: list
    query: np.ndarray
    term: np.ndarray
    times: np.ndarray

    def weighed(self, collection: Collection, df: dict[int, int]) -> Weighed:
        """Entries with their weights, without those that no document holds."""
        table = np.unique(self.term)
        held = np.array([df.get(i, 0) for i in range(len(table))], np.int64)
        weight = np.array([math.floor(1000 * math.log((2 * collection.documents + 2) / (2 * x + 1))) for x in held.tolist()], np.int64)
        at = np.searchsorted(table, self.term)
        keep = held[at] > 0
        query, at = self.query[keep], at[keep]
        live, begins = np.unique(query, return_index=True)
        return Weighed(table, at, (weight[at] * self.times[keep]), live, begins)


@dataclass
class Weighed:
    """``live`` queries, and where the entries of each begin; ``at`` is the place of an entry's term in ``table``."""

    table: np.ndarray
    at: np.ndarray
    weight: np.ndarray
    live: np.ndarray
    begins: np.ndarray


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, _, owner, term, tf in term_counts(batch.column(1)):
            cuts = np.searchsorted(owner, np.arange(end - first + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (term.view(np.int64), tf)]
            yield pa.record_batch([batch.column(0).slice(first, end - first).cast(pa.int64()), *lists], ["item_id", "terms", "times"])


def blocks(queries: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Block]:
    """The queries with terms, as many at a time as have ``most`` terms, or one with more."""
    rows = queries.select("item_id", "text").mapInArrow(_query_terms, "item_id long, terms array<long>, times array<long>").where(F.size("terms") > 0)
    items, terms, times, held = [], [], [], 0

    def block() -> Block:
        query = np.repeat(np.arange(len(items)), [len(t) for t in terms])
        return Block(items, query, np.concatenate(terms).view(np.uint64), np.concatenate(times))

    for r in materialise(rows, "queries").orderBy("item_id", "terms").toLocalIterator():
        if items and held + len(r["terms"]) > most:
            yield block()
            items, terms, times, held = [], [], [], 0
        items.append(r["item_id"])
        terms.append(np.array(r["terms"], np.int64))
        times.append(np.array(r["times"], np.int64))
        held += len(r["terms"])
    if items:
        yield block()


def collection_of(docs: DataFrame, terms: np.ndarray) -> tuple[Collection, dict[int, int]]:
    """The collection's figures, and of each of the sorted ``terms`` (by place) in how many documents it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, figures = np.zeros(len(terms), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for _, _, n, _, term, _ in term_counts(batch.column(0)):
                figures += np.count_nonzero(n), n.sum()
                place = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                df += np.bincount(place[terms[place] == term], minlength=len(terms))
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], figures))], ["place", "n"])

    counted = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    held = {r["place"]: r["n"] for r in counted.collect()}
    return Collection(held.pop(-1, 0), held.pop(-2, 0)), held


def sketches(docs: DataFrame, collection: Collection) -> DataFrame:
    """(key, sketch) of each of the documents (key, ..., text) that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, end, n, owner, term, tf in term_counts(batch.column(1)):
                distinct = np.bincount(owner, minlength=end - first)
                some = np.flatnonzero(distinct)
                width = np.zeros(end - first, np.int64)
                width[some] = 1 << np.ceil(np.log2(ROOM * distinct[some])).astype(np.int64)
                ends = np.cumsum(width)
                impact = impacts(tf, collection.length(n)[owner])
                level = -(-impact * LEVELS // MOST)
                place = (ends - width)[owner] + (term & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
                order = np.argsort(level, kind="stable")  # the largest is written last
                flat = np.zeros(int(ends[-1]), np.uint8)
                flat[place[order]] = level[order]
                offsets = pa.py_buffer(np.append(0, ends[some]).astype(np.int64))
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, offsets, pa.py_buffer(flat)])
                yield pa.record_batch([pa.array(keys[first:end][some]), held.cast(pa.binary())], ["key", "sketch"])

    return materialise(docs.select("key", "text").mapInArrow(run, "key long, sketch binary"), "sketches")


def _bounds(batch: pa.RecordBatch, block: Weighed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, upper bounds by live query and document) of the documents of a batch, some at a time."""
    keys = batch.column(0).to_numpy()
    held = batch.column(1).cast(pa.large_binary())
    at = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, held.offset * 8)
    data = np.frombuffer(held.buffers()[2], np.uint8)
    width = np.diff(at)
    weight = block.weight[:, None].astype(float)  # sums of products stay exact below 2^53
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        place = (block.table[block.at] & np.uint64(w - 1)).astype(np.int64)
        step = max(1, CELLS // max(int(w), len(place)))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            by_place = np.ascontiguousarray(np.stack([data[at[r] : at[r + 1]] for r in some], axis=1))
            units = np.add.reduceat(by_place[place] * weight, block.begins, axis=0)
            yield keys[some], units.astype(np.int64) * MOST // LEVELS


_PAIR = "query int, key long, bound long"


def _pairs(query: np.ndarray, key: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(query, pa.int32()), pa.array(key), pa.array(bound)], ["query", "key", "bound"])


def highest(sketched: DataFrame, block: Weighed, first: int = FIRST) -> DataFrame:
    """(query, key, bound): the ``first`` highest bounds of each query; every task keeps as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(block.live), 0), np.int64), np.zeros((len(block.live), 0), np.int64)
        for batch in batches:
            if not batch.num_rows or not len(block.live):
                continue
            for keys, bounds in _bounds(batch, block):
                value = np.concatenate([best[0], bounds], axis=1)
                key = np.concatenate([best[1], np.broadcast_to(keys, bounds.shape)], axis=1)
                if value.shape[1] > first:
                    take = np.argpartition(-value, first - 1, axis=1)[:, :first]
                    value, key = np.take_along_axis(value, take, 1), np.take_along_axis(key, take, 1)
                best = value, key
        q, j = np.nonzero(best[0])
        yield _pairs(block.live[q], best[1][q, j], best[0][q, j])

    order = Window.partitionBy("query").orderBy(F.col("bound").desc(), "key")
    found = sketched.mapInArrow(run, _PAIR)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).drop("place")


def above(sketched: DataFrame, block: Weighed, threshold: np.ndarray) -> DataFrame:
    """(query, key, bound) of all pairs whose bound is at or above the query's threshold."""
    least = threshold[block.live][:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(block.live):
                for keys, bounds in _bounds(batch, block):
                    q, j = np.nonzero(bounds >= least)
                    yield _pairs(block.live[q], keys[j], bounds[q, j])

    return sketched.mapInArrow(run, _PAIR)


_SCORED = "query int, doc_id long, score long"


def _best(rows: list[np.ndarray], top: int) -> list[np.ndarray]:
    """The ``top`` best of each query of rows (query, score, whether the id is null, id)."""
    query, score, no_id, doc_id = rows
    order = np.lexsort((doc_id, no_id, -score, query))
    query = query[order]
    begins = np.searchsorted(query, query)
    order = order[np.arange(len(query)) - begins < top]
    return [x[order] for x in rows]


def scored(docs: DataFrame, block: Weighed, collection: Collection, threshold: np.ndarray, top: int) -> DataFrame:
    """(query, doc_id, score) with scores at or above the thresholds, a task's best of each query."""
    least = threshold[block.live]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        rows = [none] * 4
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            no_id = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, n, owner, term, tf in term_counts(batch.column(1)):
                place = np.minimum(np.searchsorted(block.table, term), len(block.table) - 1)
                hit = block.table[place] == term
                place, owner, tf = place[hit], owner[hit], tf[hit]
                impact = impacts(tf, collection.length(n)[owner])
                bounds = np.searchsorted(owner, np.arange(end - first + 1))
                made = [rows]
                for i in np.flatnonzero(np.diff(bounds)):
                    held = np.zeros(len(block.table), np.int64)
                    held[place[bounds[i] : bounds[i + 1]]] = impact[bounds[i] : bounds[i + 1]]
                    score = np.add.reduceat(held[block.at] * block.weight, block.begins)
                    q = np.flatnonzero(score >= least)
                    made.append([block.live[q], score[q], np.full(len(q), no_id[first + i]), np.full(len(q), ids[first + i])])
                rows = [np.concatenate(x) for x in zip(*made)]
                if len(rows[0]) > HELD:
                    rows = _best(rows, top)
        query, score, no_id, doc_id = _best(rows, top)
        yield pa.record_batch([pa.array(query, pa.int32()), pa.array(doc_id, mask=no_id.astype(bool)), pa.array(score)], ["query", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, _SCORED)


def _of_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents with one of the distinct ``keys``, which go to every executor if their bytes are few."""
    few = keys.count() * KEY_BYTES <= BROADCAST_BYTES
    return docs.join(F.broadcast(keys) if few else keys, "key", "left_semi")


def _slab(pairs: DataFrame, threshold: np.ndarray, size: int) -> np.ndarray:
    """For each query the bound down to which about ``size`` of its pairs lie, or all: by a histogram of bounds over the threshold."""
    over = pairs.join(F.broadcast(_numbers(pairs.sparkSession, threshold)), "query")
    bin_ = F.least(F.lit(255), F.floor((F.col("bound") - F.col("least")) * 256 / (F.col("least") + 1)))
    bins = over.groupBy("query", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("bound").alias("low"))
    down = Window.partitionBy("query").orderBy(F.col("bin").desc())
    reached = bins.withColumn("so_far", F.sum("n").over(down)).withColumn("n_before", F.row_number().over(down))
    cut = reached.where((F.col("so_far") <= size) | (F.col("n_before") == 1)).groupBy("query").agg(F.min("low").alias("low"))
    out = np.full(len(threshold), np.iinfo(np.int64).max)
    for r in cut.collect():
        out[r["query"]] = r["low"]
    return out


def _numbers(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """(query, least): one row per query of a block."""
    return spark.createDataFrame(list(enumerate(values.tolist())), "query int, least long")


def _search_block(docs: DataFrame, sketched: DataFrame, block: Block, collection: Collection, df: dict[int, int], top: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of the queries of one block."""
    spark, weighed = docs.sparkSession, block.weighed(collection, df)
    threshold = np.ones(len(block.items), np.int64)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = done = rest = None

    def rescore(keys: DataFrame) -> None:
        """Score the documents of stored ``keys``; the best rows and thresholds follow."""
        nonlocal best, done
        made = scored(_of_keys(docs, keys), weighed, collection, threshold, top)
        made = made if best is None else made.unionByName(best.drop("rank"))
        best = materialise(made.withColumn("rank", rank).where(F.col("rank") <= top), "best")
        for r in best.where(F.col("rank") == top).collect():
            threshold[r["query"]] = r["score"]
        done = keys if done is None else done.unionByName(keys)

    rescore(materialise(highest(sketched, weighed, max(top, FIRST)).select("key").distinct(), "keys"))
    rest = materialise(above(sketched, weighed, threshold).join(done, "key", "left_anti"), "pairs")
    size = FIRST * GROWTH
    while not rest.isEmpty():
        low = _numbers(spark, _slab(rest, threshold, size))
        slab = rest.join(F.broadcast(low), "query").where("bound >= least").select("key").distinct()
        rescore(materialise(slab, "keys"))
        still = rest.join(F.broadcast(_numbers(spark, threshold)), "query").where("bound >= least").drop("least")
        rest = materialise(still.join(done, "key", "left_anti"), "pairs")
        size *= GROWTH
    names = spark.createDataFrame(list(enumerate(block.items)), "query int, item_id long")
    return best.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` best documents of each query (item_id, text): item_id, rank, doc_id, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    out = sketched = None
    for block in blocks(queries, block_terms):
        collection, df = collection_of(docs, np.unique(block.term))
        if not collection.documents:
            break
        if sketched is None:
            sketched = sketches(docs, collection)
        found = _search_block(docs, sketched, block, collection, df, top)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
