"""Best-fit packing of token sequences by bin completion with branch and bound.

A text becomes its token ids and one closing id. Only a longer text is cut, into pieces of the capacity, of
which the first may be shorter. What is packed is lengths, and there are at most ``capacity`` of them: Spark
counts the pieces of each length, and the plan is made on these counts alone, whatever the size of the
corpus.

*Plan.* Best-fit decreasing gives the first incumbent. Then bins are completed: around the largest length
left, fillings of the rest of the bin are listed, least waste first and among these the largest lengths first. Which sums the lengths left can
make is one bit string for each length, so the listing runs into no dead ends. A filling is dominated, and dropped, if a length that it leaves
out could stand in place of some of its pieces without being smaller than these: they would then be left, and are easier to place. Of the undominated ones the first
``FILLINGS`` are tried. A filling is used as often as the counts allow. A branch ends when its waste exceeds
what a plan of fewer bins than the incumbent's can have; the search ends when the incumbent meets the lower bound, when
all branches are done, or after ``NODE_LIMIT`` fillings. The lower bound is the best of the sum, of pieces over each threshold with what may go
beside them, and of the exact number of bins for pieces over a third, of which two go to a bin. ``Planned.proved`` tells whether no plan of
fewer bins exists; where fillings were left out or the limit was reached, it does not claim so. The incumbent always packs every piece.

*Assignment.* The pieces of a length are numbered in two steps (by length and hash range, then
inside a range), and a number tells the bin and the place in it.

Defined results: a null or empty text is the closing id alone. Repeated rows are packed each, rows equal in doc_id, piece and ids in any order
among themselves. A null doc_id is carried. The strings of special tokens in a text become these tokens, as the tokenizer file
says. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm import bytewise
from concordat.session import materialise

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CLOSING_ID = 0
NODE_LIMIT = 4000
FILLINGS = 4
TRIES = 64  # fillings looked at for one list of them
ROWS_PER_RANGE = 50_000

Filling = tuple[tuple[int, int], ...]  # (length, how often), largest first
Plan = list[tuple[Filling, int]]  # and in how many bins

_encoders: dict[tuple[str, str, bool], object] = {}


class _Encoder:
    """Ids of a text by the byte-level vocabulary.

    The same vocabulary is there as ranks for a faster library; what that one refuses goes to the tokenizer file, and so do
    texts with the string of a special token, unless such strings are to be ordinary text.
    """

    def __init__(self, tokenizer: str, ranks: str, ordinary: bool):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={})
        self.plain = Tokenizer.from_file(tokenizer)
        self.plain.encode_special_tokens = ordinary
        self.special = [] if ordinary else [t.content for t in self.plain.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> np.ndarray:
        if not any(t in text for t in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except Exception:  # noqa: BLE001 - what the faster library refuses
                pass
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(tokenizer: str, ranks: str, ordinary: bool = True) -> _Encoder:
    """``ordinary``: strings of special tokens are text like other, as a scan for a separator needs it."""
    if (tokenizer, ranks, ordinary) not in _encoders:
        _encoders[tokenizer, ranks, ordinary] = _Encoder(tokenizer, ranks, ordinary)
    return _encoders[tokenizer, ranks, ordinary]


def _cut(tokenizer: str, ranks: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks, ordinary=False)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(CLOSING_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    held = ids[a:b]
                    out.append((doc_id, i, a, b - a, zlib.crc32(held.tobytes()), *([held.astype(np.int32)] if with_ids else [])))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def cut(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every text."""
    tokenizer, ranks = tokenizer or public_tokenizers.path(TOKENIZER), ranks or public_tokenizers.path(RANKS)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(bytewise.tidy(_cut(tokenizer, ranks, capacity, with_ids)), schema)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts: bins with one filling stand and are filled together."""
    groups: dict[int, list[list]] = {}  # room -> [filling, bins]
    rooms: list[int] = []

    def put(room: int, filling: Filling, bins: int) -> None:
        if not bins:
            return
        if room not in groups:
            groups[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        groups[room].append([filling, bins])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(capacity, (), -(-left // (capacity // length)))
                continue
            room = rooms[at]
            filling, bins = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = min(room // length, left)
            full = min(bins, left // each)
            put(room - each * length, filling + ((length, each),), full)
            left -= full * each
            bins -= full
            if bins and left and left < each:
                put(room - left * length, filling + ((length, left),), 1)
                bins, left = bins - 1, 0
            if filling:
                put(room, filling, bins)
    return [(filling, bins) for held in groups.values() for filling, bins in held]


def _reachable(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Bit strings of the sums up to ``room`` that the first 0, 1, 2, ... of the sizes can make."""
    reach, mask = [1], (1 << room + 1) - 1
    for size in sizes:
        bits, left, k = reach[-1], min(counts[size], room // size), 1
        while left:
            step = min(k, left)
            bits |= bits << step * size & mask
            left, k = left - step, 2 * k
        reach.append(bits)
    return reach


def _with_sum(sizes: list[int], counts: dict[int, int], reach: list[int], total: int) -> Iterator[Filling]:
    """All fillings of that sum, the largest lengths first."""
    stack: list[tuple[int, int, Filling]] = [(len(sizes), total, ())]
    while stack:
        at, left, filling = stack.pop()
        while at and left and not sizes[at - 1] <= left:
            at -= 1
        if not left:
            yield filling
            continue
        size = sizes[at - 1]
        for k in range(min(counts[size], left // size) + 1):
            if reach[at - 1] >> left - k * size & 1:
                stack.append((at - 1, left - k * size, filling + ((size, k),) if k else filling))


def dominated(filling: Filling, waste: int, sizes: list[int], counts: dict[int, int]) -> bool:
    """Whether a length that is left out fits in place of pieces that together are no larger."""
    used = dict(filling)

    def sums(without: int = 0) -> int:
        bits = 1
        for size, k in filling:
            if size != without:
                for _ in range(k):
                    bits |= bits << size
        return bits

    whole = sums()
    window = (1 << waste + 1) - 1
    for size in sizes:
        if counts[size] > used.get(size, 0):
            bits = sums(size) if size in used else whole
            least = size - waste
            # Pieces of a sum in [size - waste, size], at least one of them.
            found = bits >> least & window if least > 0 else (bits & (1 << size + 1) - 1) >> 1
            if found or least <= 0:
                return True
    return False


def fillings(sizes: list[int], counts: dict[int, int], room: int, most_waste: int, keep: int = FILLINGS) -> tuple[list[tuple[int, Filling]], bool]:
    """Up to ``keep`` undominated (waste, filling) of ``room``, least waste first, and whether these are all there are."""
    usable = sizes[: bisect_right(sizes, room)]
    reach, out, tries = _reachable(usable, counts, room), [], 0
    for waste in range(min(most_waste, room) + 1):
        if not reach[-1] >> room - waste & 1:
            continue
        for filling in _with_sum(usable, counts, reach, room - waste):
            if len(out) == keep or tries == TRIES:
                return out, False
            tries += 1
            if not dominated(filling, waste, usable, counts):
                out.append((waste, filling))
    return out, True


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that no plan can do without."""
    sizes = sorted(counts)
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    # Pieces over capacity - a stand alone but for pieces under a; the others over a half have room for what is between.
    for a in [0, *(n for n in sizes if 2 * n <= capacity)]:
        alone = sum(c for n, c in counts.items() if n > capacity - a)
        half = [(n, c) for n, c in counts.items() if 2 * n > capacity and n <= capacity - a]
        between = sum(n * c for n, c in counts.items() if a <= n and 2 * n <= capacity)
        room = sum((capacity - n) * c for n, c in half)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-(between - room) // capacity)))
    # Of pieces over a k-th part, fewer than k go to a bin.
    upto = list(accumulate(counts[n] for n in sizes))
    for k in range(2, capacity // sizes[0] + 2):
        below = bisect_right(sizes, capacity // k)
        best = max(best, -(-(upto[-1] - (upto[below - 1] if below else 0)) // (k - 1)))
    # Two pieces over a third at most go to a bin: the largest with the smallest that fits it, or alone.
    left = {n: c for n, c in counts.items() if 3 * n > capacity}
    order = sorted(left)
    i, j, bins = 0, len(order) - 1, 0
    while i <= j:
        small, large = order[i], order[j]
        if not left[small]:
            i += 1
        elif not left[large]:
            j -= 1
        elif small + large > capacity:
            bins, left[large] = bins + left[large], 0
        elif i == j:
            bins, left[small] = bins + (left[small] + 1) // 2, 0
        else:
            both = min(left[small], left[large])
            bins, left[small], left[large] = bins + both, left[small] - both, left[large] - both
    return max(best, bins)


@dataclass
class Planned:
    """A plan, a number of bins that none can go below, and whether the plan is known to be the best."""

    plan: Plan
    bound: int
    proved: bool

    @property
    def bins(self) -> int:
        return sum(bins for _, bins in self.plan)


def search(counts: dict[int, int], capacity: int = CAPACITY, node_limit: int = NODE_LIMIT, keep: int = FILLINGS) -> Planned:
    """Bin completion with branch and bound, best fit decreasing as the first incumbent."""
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return Planned([], 0, True)
    total = sum(n * c for n, c in counts.items())
    incumbent = best_fit(counts, capacity)
    fewest = sum(bins for _, bins in incumbent)
    bound, nodes, all_tried = lower_bound(counts, capacity), node_limit, True
    left, sizes = dict(counts), sorted(counts)
    #: (filling, bins, waste before, other fillings not tried)
    path: list[tuple[Filling, int, int, list[tuple[int, Filling]]]] = []
    waste = 0

    def change(filling: Filling, bins: int, sign: int) -> None:
        for n, k in filling:
            had = left.get(n, 0)
            left[n] = had + sign * k * bins
            if left[n] == 0:
                sizes.pop(bisect_left(sizes, n))
            elif had == 0:
                sizes.insert(bisect_left(sizes, n), n)

    while fewest > bound and nodes > 0:
        allowed = (fewest - 1) * capacity - total
        options: list[tuple[int, Filling]] = []
        if sizes and waste <= allowed:
            top = sizes[-1]
            change(((top, 1),), 1, -1)
            options, complete = fillings(sizes, left, capacity - top, allowed - waste, keep)
            change(((top, 1),), 1, 1)
            nodes, all_tried = nodes - 1, all_tried and complete
            options = [(w, ((top, 1),) + f if not f or f[0][0] != top else ((top, 1 + f[0][1]),) + f[1:]) for w, f in options]
        elif not sizes and waste <= allowed:
            incumbent, fewest = [(f, b) for f, b, *_ in path], sum(b for _, b, *_ in path)
        while not options and path:
            filling, bins, waste, options = path.pop()
            change(filling, bins, 1)
        if not options:
            return Planned(incumbent, bound, fewest == bound or all_tried)
        (lost, filling), rest = options[0], options[1:]
        bins = min(left[n] // k for n, k in filling)
        if lost:
            bins = min(bins, max(1, ((fewest - 1) * capacity - total - waste) // lost))
        path.append((filling, bins, waste, rest))
        # Another number of such bins is another branch, which is not tried.
        all_tried = all_tried and bins == 1
        change(filling, bins, -1)
        waste += lost * bins
    return Planned(incumbent, bound, fewest == bound)


def plan(counts: dict[int, int], capacity: int = CAPACITY, node_limit: int = NODE_LIMIT) -> Plan:
    """Fillings and how many bins have each, for all pieces of the given counts by length."""
    return search(counts, capacity, node_limit).plan


def _table(made: Plan) -> tuple[np.ndarray, ...]:
    """Slots of the plan by (length, first number): key, first number, how often in a bin, first bin, place."""
    rows, given, first_bin = [], {}, 0
    for filling, bins in made:
        place = 0
        for length, often in filling:
            begin = given.get(length, 0)
            rows.append(((length << 44) + begin, begin, often, first_bin, place))
            given[length] = begin + often * bins
            place += length * often
        first_bin += bins
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else tuple(np.zeros((5, 0), np.int64))


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored ``pieces``."""
    held = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = pieces.sparkSession.sparkContext.broadcast(_table(plan(held, capacity)))
    ranges = max(1, -(-sum(held.values()) // ROWS_PER_RANGE))
    columns = pieces.columns
    at = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(ranges)).cast("int"))
    sums = at.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = at.withColumn("_number", F.row_number().over(inside)).join(sums, ["length", "_part"])
    numbered = numbered.select(*columns, (F.col("_base") + F.col("_number") - 1).alias("_number"))
    length_at, number_at = columns.index("length"), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begin, often, first_bin, place = table.value
        for batch in batches:
            length, number = batch.column(length_at).to_numpy(), batch.column(number_at).to_numpy()
            slot = np.searchsorted(key, (length << 44) + number, "right") - 1
            within = number - begin[slot]
            sequence, offset = first_bin[slot] + within // often[slot], place[slot] + within % often[slot] * length
            yield pa.record_batch([*batch.columns[:number_at], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return numbered.mapInArrow(bytewise.tidy(run), schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return assign(materialise(cut(docs, capacity, tokenizer, ranks, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from pieces that carry their ids."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return held.select("sequence_id", F.flatten(F.transform("held", lambda p: p["ids"])).alias("ids"))
