"""N-gram Jaccard join: PartEnum signatures, exact verification, connected components.

Words are lower-cased (A-Z) runs of bytes that are not white space; the set of a text holds the
hashes of its distinct shingles of ``width`` words, or of the whole sequence if it has fewer.

*Signatures.* Sizes are cut into bands that grow by 1/threshold, so linked sets lie in one band or
in neighbouring ones. An instance covers a band and the next. There the feature domain (the
range of a hash) is cut into ``n`` equal parts and the part of a set in each is hashed. Two sets
with a symmetric difference of at most ``k`` differ in at most ``k`` parts; with ``f`` filled parts
they agree on at least ``f - k`` filled ones. So only filled parts are used, and of these only the
``k + 1`` first in a common order (fullest first): if ``f > k``, two linked sets share one of them.
A set with ``f <= k`` (small ones, by chance) gives each of its features as a signature as well.

*Candidates.* The sets of a signature are compared with one of them (a star, not all pairs), linked ones fall
into components, and signatures that still have several components are compared with another of their members,
``STAR_ROUNDS`` times. What is left are pairs of members in different components. These are compared in
blocks. Before a pair is verified on whole sets, the counts of both sets in ``CELLS`` cells of the hash range have to
allow the link: their differences add up to no more than the sets differ by.

Texts with one set are one node from the start, so copies cost nothing further. Nodes are 64-bit
sums of mixed feature hashes: among ``d`` different sets two share a node with odds d*d/2^65.

Defined results: a null or wordless text has an empty set, ``n_shingles`` 0, and is its own
component. Rows with one doc_id are kept as they are. A null doc_id takes part but never names a
component; it is null where a component has no other. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm import bytewise
from concordat.llm.components import components
from concordat.llm.skew import join_groups
from concordat.session import materialise

WIDTH = 5
PERCENT = 80
CELLS = 512
STAR_ROUNDS = 2  # after the first
PAIRS = 1 << 13  # compared at a time
BLOCK = 512  # sets of one signature that meet another such block in one group
BROADCAST_BYTES = 32 << 20
KEY_BYTES = 32  # of a long in a broadcast table
SEEN = 1 << 20  # nodes a task remembers so as to give the signatures of copies once

_SMALL = np.uint64(0xA0761D6478BD642F)


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, features, set sizes) of runs of rows: sorted distinct features, text after text."""
    for first, end, data, at in bytewise.pieces(column):
        starts, ends, owners = bytewise.spans(~bytewise.SEPARATOR[data], at)
        words = bytewise.span_hashes(data, starts, ends, lower=True)
        rows = end - first
        inside = bytewise.inside_one_text(owners, width)
        features, of = bytewise.window_hashes(words, width)[inside], owners[: len(inside)][inside]
        n_words = np.bincount(owners, minlength=rows)
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        if len(short):
            begins = np.concatenate([[0], np.cumsum(n_words)])
            whole = np.zeros(len(short), np.uint64)
            for i in range(width - 1):
                has = n_words[short] > i
                whole[has] += words[begins[short[has]] + i] * bytewise._FACTORS[i]
            whole = bytewise.mix(whole + n_words[short].astype(np.uint64) * _SMALL)
            place = np.searchsorted(of, short)
            features, of = np.insert(features, place, whole), np.insert(of, place, short)
        bounds = np.searchsorted(of, np.arange(rows + 1))
        for i in range(rows):
            features[bounds[i] : bounds[i + 1]].sort()
        fresh = np.ones(len(features), bool)
        fresh[1:] = (features[1:] != features[:-1]) | (of[1:] != of[:-1])
        yield first, features[fresh], np.bincount(of[fresh], minlength=rows)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of ``sizes`` values, modulo 2^64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _nodes(features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return bytewise.mix(_sums(bytewise.mix(features), sizes) + sizes.astype(np.uint64)).view(np.int64)


def bands(percent: int) -> np.ndarray:
    """First sizes of the bands; a linked set is in the band of the other or the next."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def signatures_of(features: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) pairs of the sets laid end to end in ``features``."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    mixed, edges = bytewise.mix(features), bands(percent)
    out, owners = [], []
    for below in (0, 1):
        band = np.searchsorted(edges, sizes, "right") - 1 - below
        valid = (sizes > 0) & (band >= 0)
        largest = edges[np.clip(band + 2, 0, len(edges) - 1)] - 1
        differ = (100 - percent) * (sizes + np.minimum(largest, sizes * 100 // percent)) // (100 + percent)
        valid &= differ > 0  # else only equal sets are linked, and those are one node
        parts = (100 - percent) * 2 * largest * 9 // ((100 + percent) * 8) + 2
        part = ((features >> np.uint64(32)) * parts[of].astype(np.uint64)) >> np.uint64(32)
        take = valid[of]
        f_of, f_part, f_mixed = of[take], part[take], mixed[take]
        if not len(f_of):
            continue
        begins = np.ones(len(f_of), bool)
        begins[1:] = (f_part[1:] != f_part[:-1]) | (f_of[1:] != f_of[:-1])
        begins = np.flatnonzero(begins)
        owner = f_of[begins]
        count = np.diff(np.append(begins, len(f_of)))
        salt = bytewise.mix((band[owner].astype(np.uint64) << np.uint64(40)) + f_part[begins])
        made = bytewise.mix(np.add.reduceat(f_mixed, begins) + salt)
        filled = np.bincount(owner, minlength=len(sizes))
        order = np.lexsort((made, -count, owner))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(filled) - filled, filled)
        first = order[rank <= differ[owner[order]]]
        out.append(made[first])
        owners.append(owner[first])
        if below == 0:
            # With f > k in every instance of one of two linked sets, a signature is shared.
            odd = valid & (filled <= differ)
        else:
            odd |= valid & (filled <= differ)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    extra = odd[of]
    out.append(bytewise.mix(mixed[extra] ^ _SMALL))
    owners.append(of[extra])
    return np.concatenate(out), np.concatenate(owners)


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = [], []
            for _, features, n in sets_of(batch.column(1), width):
                sizes.append(n)
                nodes.append(_nodes(features, n))
            if sizes:
                n = np.concatenate(sizes)
                node = pa.array(np.concatenate(nodes), mask=n == 0)
                yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n, pa.int64()), node], ["doc_id", "key", "n_shingles", "node"])

    return run


def _signatures(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, features, n in sets_of(batch.column(0), width):
                nodes = _nodes(features, n)
                fresh = np.zeros(len(n), bool)
                for i, node in enumerate(nodes.tolist()):
                    if n[i] and node not in seen:
                        seen.add(node)
                        fresh[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                made, of = signatures_of(features[np.repeat(fresh, n)], n[fresh], percent)
                if len(made):
                    yield pa.record_batch([pa.array(made.view(np.int64)), pa.array(nodes[fresh][of])], ["sig", "node"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, node) become (sig, hub, node), hub being the first node of the signature."""
    last_sig = last_hub = last_node = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        begins = np.ones(len(sig), bool)
        begins[1:] = sig[1:] != sig[:-1]
        again = np.zeros(len(sig), bool)
        again[1:] = ~begins[1:] & (node[1:] == node[:-1])
        at = np.flatnonzero(begins)
        hub = np.repeat(node[at], np.diff(np.append(at, len(sig))))
        if last_sig is not None and sig[0] == last_sig:
            hub[: at[1] if len(at) > 1 else len(sig)] = last_hub
            again[0] = node[0] == last_node
        keep = (hub != node) & ~again
        last_sig, last_hub, last_node = sig[-1], hub[-1], node[-1]
        if keep.any():
            yield pa.record_batch([pa.array(sig[keep]), pa.array(hub[keep]), pa.array(node[keep])], ["sig", "hub", "node"])


def _cells(width: int):
    """Features of each set by cell of the hash range, for a bound on the difference of two sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, features, n in sets_of(batch.column(0), width):
                of = np.repeat(np.arange(len(n)), n)
                cell = ((features >> np.uint64(13)) % np.uint64(CELLS)).astype(np.int64)
                counts = np.bincount(of * CELLS + cell, minlength=len(n) * CELLS)
                counts = np.minimum(counts, 255).astype(np.uint8).reshape(len(n), CELLS)
                held = pa.array([row.tobytes() for row in counts], pa.binary())
                yield pa.record_batch([pa.array(_nodes(features, n)), pa.array(n, pa.int64()), held], ["node", "n", "cells"])

    return run


def _whole_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, features, n in sets_of(batch.column(0), width):
                cuts = np.concatenate([[0], np.cumsum(n)])
                held = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(features.view(np.int64)))
                yield pa.record_batch([pa.array(_nodes(features, n)), held], ["node", "features"])

    return run


def _allowed(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether the cell counts of two sets leave room for a link: a lower bound of their difference."""
    apart = np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(1, dtype=np.int64)
    return apart * (100 + percent) <= (100 - percent) * (n + m)


def _close_pairs(percent: int):
    """Rows sorted by (sig, low, high, node, ...) become pairs that the cell counts don't rule out.

    A group is one block of a signature, or two that meet; it has at most some thousand rows and is
    held whole, with the rest of a batch carried on.
    """

    def pairs(sig, low, high, block, node, comp, n, cells):
        begins = np.ones(len(sig), bool)
        begins[1:] = (sig[1:] != sig[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        group = np.cumsum(begins)
        longest = int(np.bincount(group).max())
        for step in range(1, longest):
            i = np.flatnonzero(group[step:] == group[:-step])
            if not len(i):
                break
            j = i + step
            ok = (comp[i] != comp[j]) & ((low[i] == high[i]) | (block[i] != block[j]))
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok &= 100 * small >= percent * large
            i, j = i[ok], j[ok]
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                near = _allowed(cells[x], cells[y], n[x], n[y], percent)
                if near.any():
                    a, b = node[x[near]], node[y[near]]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            held = b"".join(v.as_py() for v in batch.column(7))
            cols.append(np.frombuffer(held, np.uint8).reshape(-1, CELLS))
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from pairs(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
        if rest is not None and len(rest[0]):
            yield from pairs(*rest)

    return run


def _some_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts of the documents with one of the stored ``keys``, which are sent to every executor if their bytes are few.

    A key is a hash of doc_id and text. A text more, by two with one hash, does no harm.
    """
    few = keys.count() * KEY_BYTES <= BROADCAST_BYTES
    return docs.join(F.broadcast(keys) if few else keys, "key", "left_semi").select("text")


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough; each side's set comes by a join on its node."""
    whole = texts.mapInArrow(bytewise.tidy(_whole_sets(width)), "node long, features array<long>")
    one = whole.select(F.col("node").alias("a"), F.col("features").alias("fa"))
    two = whole.select(F.col("node").alias("b"), F.col("features").alias("fb"))
    both = pairs.join(one, "a").join(two, "b")
    # Features of a set are distinct, so the intersection's size is that of the sets'.
    sizes = both.select("a", "b", F.size("fa").cast("long").alias("n"), F.size("fb").cast("long").alias("m"), F.size(F.array_intersect("fa", "fb")).cast("long").alias("both"))
    return sizes.where(100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b")


def similarity_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reached by links)."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    known = materialise(docs.mapInArrow(bytewise.tidy(_profile(width)), "doc_id long, key long, n_shingles long, node long"), "sets")

    made = docs.select("text").mapInArrow(bytewise.tidy(_signatures(width, percent)), "sig long, node long")
    stars = made.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(bytewise.tidy(_stars), "sig long, hub long, node long")
    stars = materialise(stars, "stars")

    star_pairs = stars.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    candidates = star_pairs.select(F.col("a").alias("node")).unionByName(star_pairs.select(F.col("b").alias("node"))).distinct()
    # A node's copies fold before they move, so a join by node meets one row of each.
    one = known.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("key"))
    keys = materialise(one.join(candidates, "node").select("key").distinct(), "candidates")
    texts = _some_texts(docs, keys)
    cells = materialise(texts.mapInArrow(bytewise.tidy(_cells(width)), "node long, n long, cells binary").dropDuplicates(["node"]), "cells")

    found = components(materialise(_linked(_near(star_pairs, cells, percent), texts, width, percent), "linked"))
    for n in range(STAR_ROUNDS):
        pairs = materialise(_near(_other_stars(_unresolved(stars, found), n), cells, percent), "pairs")
        found = _extended(found, pairs, texts, width, percent)
    pairs = materialise(_blocks(_unresolved(stars, found), cells).mapInArrow(bytewise.tidy(_close_pairs(percent)), "a long, b long").distinct(), "pairs")
    found = _extended(found, pairs, texts, width, percent)
    return _named(known, found)


def _named(known: DataFrame, found: DataFrame) -> DataFrame:
    """The components' least ids brought back to the documents; one set's copies, or one component's sets, may be a third of all."""
    held = known.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    rooted = materialise(held.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    total, sets = rooted.agg(F.sum("copies"), F.count(F.lit(1))).first()
    named = join_groups(rooted.select("root", "node", "copies"), least, "root", "sets", sets)
    named = materialise(named.select("node", "component_id", "copies"), "named")
    with_words = join_groups(known.where("node IS NOT NULL"), named, "node", "copies", total or 0).select("doc_id", "n_shingles", "component_id")
    return with_words.unionByName(known.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _extended(found: DataFrame, pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Components once those of stored ``pairs`` that are linked have been added: on the graph of what was found, not on all links."""
    if pairs.isEmpty():
        return found
    more = materialise(_linked(pairs, texts, width, percent), "linked")
    if more.isEmpty():
        return found
    root_of = lambda end: found.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    ends = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    ends = materialise(ends.select("a", "b", F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y")), "merging")
    up = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("above"))
    alone = ends.select(F.col("a").alias("node"), F.col("x").alias("root")).unionByName(ends.select(F.col("b").alias("node"), F.col("y").alias("root")))
    every = found.select("node", "root").unionByName(alone.where("node = root")).distinct()
    # Few roots rise; Spark sends them to every executor where their stored bytes allow it.
    return materialise(every.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "components")


def _other_stars(rest: DataFrame, n: int) -> DataFrame:
    """Pairs of a member of each signature, another one for each ``n``, with those in other components."""
    hub = rest.groupBy("sig").agg(F.min_by(F.struct("node", "comp"), F.xxhash64(F.lit(n), "node")).alias("hub"))
    both = rest.join(hub, "sig").where("comp <> hub.comp")
    return both.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _near(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and cell counts don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(i)), np.uint8).reshape(-1, CELLS) for i in (4, 5))
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            for at in range(0, len(ok), PAIRS):
                cut = slice(at, at + PAIRS)
                ok[cut] &= _allowed(x[cut], y[cut], n[cut], m[cut], percent)
            ok = pa.array(ok)
            yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    one = cells.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    two = cells.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ca", "cb")
    return both.mapInArrow(bytewise.tidy(run), "a long, b long")


def _unresolved(stars: DataFrame, found: DataFrame) -> DataFrame:
    """(sig, node, comp) of signatures whose members other than the hub lie in several components.

    Signatures with the same members are taken once.
    """
    member = stars.select("sig", "node").join(found, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("comp"))
    held = member.groupBy("sig").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("print"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("print2"),
    )
    kept = held.where("low <> high").groupBy("print", "print2", "rows").agg(F.min("sig").alias("sig")).select("sig", "rows")
    return member.join(kept, "sig")


def _blocks(rest: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of a large signature go to each pair of blocks that theirs takes part in."""
    n = F.ceil(F.col("rows") / BLOCK)
    dealt = rest.join(cells, "node").withColumn("block", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    dealt = dealt.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with"))
    dealt = dealt.select("sig", "lo", "hi", "block", "node", "comp", "n", "cells")
    return dealt.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "node")


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, without those linked to a document of a smaller doc_id.

    The few ids that go are looked up; rows that share a doc_id go or stay together. Rows of equal sets have to
    differ in doc_id for all but one to go, so exact dedup comes first. Null ids stay.
    """
    gone = similarity_classes(docs, width, percent).where("doc_id <> component_id").select("doc_id").distinct()
    gone = materialise(gone, "gone")
    few = gone.count() * KEY_BYTES <= BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
