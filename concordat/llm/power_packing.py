"""Packing by power-of-two decomposition: pieces of binary length, bucketed by length.

A text becomes its token ids and one closing id. A document of ``n`` ids is cut from the front into as many pieces of
the capacity as fit, and then into one piece for each binary digit of the rest, longest first. Each piece is a
sequence by itself, so no sequence crosses documents and none is padded. Sequences of one length are a bucket; a bucket's
sequences are numbered one after the other, longest bucket first, and so many of them that they hold
``batch_tokens`` ids make a batch. A batch is thus of one length, and all but a bucket's last have the same number of ids.

The task that cuts a piece also gives its number among the task's pieces of that length. Stored once, these numbers
and the sums of the (length, task) counts before them give the sequence ids: no piece is shuffled for
its number, and no bucket is held by one task, however many pieces have one length.

*Ids.* Words are what white space of ASCII separates. The tokenizer cuts there as well and its steps (composition,
lower case, merges) never reach over white space, so the ids of a text are those of its words in a row. A task
remembers words with their ids up to ``MOST_WORDS`` words and ``MOST_BYTES`` bytes and then starts anew. New words of plain
letters, digits and marks (``PLAIN``, for which composition does nothing) go, in lower case and cut as the file says, to a faster
library with the merges of the file as ranks, a blank standing for the end of a word; others go to the tokenizer. A text with the
first characters of a special string that the tokenizer file knows is given to the tokenizer whole.

Defined results: a null or empty text is the closing id alone, one sequence of one id. Repeated rows are packed each. A null
doc_id is carried. Equal pieces are ordered by task and place. An empty table gives no rows. Other columns are
not read, whatever their names. Sequence ids of the same files and settings are the same again; the pieces always are.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm import bytewise
from concordat.session import materialise

CAPACITY = 4096
BATCH_TOKENS = 1 << 19
TOKENIZER = "word_bpe_49k.json"
CLOSING_ID = 2
MARK = b"<|"
MOST_WORDS = 800_000
MOST_BYTES = 32 << 20
#: Words of these characters alone: none composes, and each has a lower case of one character.
PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u02ff]+")
#: The steps of the tokenizer file that the faster way follows. For a file with others it is not taken.
WORD_END = "</w>"
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = ["NFC", "Replace", "Lowercase"]

_encoders: dict[str, WordEncoder] = {}


class _Places(dict):
    """Word -> place; a word that is not there gets the next place and is noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.fresh.append(word)
        return place


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Merges:
    """Ids of plain words by the merges of a tokenizer file, each word cut into parts that end in a blank."""

    def __init__(self, held: dict):
        import tiktoken

        letters = _byte_letters()
        as_bytes = lambda t: bytes(letters[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END)
        vocab = held["model"]["vocab"]
        # A last byte and the blank after it are merged before anything else.
        tokens = [f"{c}{WORD_END}" for c in letters] + list(letters)
        for pair in held["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            tokens.append(a + b)
        ranks = {as_bytes(t): i for i, t in enumerate(tokens)}
        if len(ranks) != len(tokens):
            raise ValueError("a token is made by two merges")
        self.ids = np.array([vocab[t] for t in tokens], np.uint32)
        self.ends = np.array([t.endswith(WORD_END) for t in tokens])
        self.cuts = regex.compile(CUTS)
        self.bpe = tiktoken.Encoding("merges", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def of(path: str) -> _Merges | None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        steps = (held.get("normalizer") or {}).get("normalizers", [])
        cuts = (held.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        fits = [s["type"] for s in steps] == STEPS and cuts.get("pattern") == {"Regex": CUTS} and held["model"].get("end_of_word_suffix") == WORD_END
        return _Merges(held) if fits else None

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        parts = [self.cuts.findall(w.lower()) for w in words]
        flat = [p for held in parts for p in held]
        found = self.bpe.encode_to_numpy(" ".join(flat) + " ", disallowed_special=()) if flat else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], np.flatnonzero(self.ends[found]) + 1])[np.cumsum([len(p) for p in parts])]
        return self.ids[found], np.diff(upto, prepend=0)


class WordEncoder:
    """Ids of texts, word by word, with the words seen last remembered."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.plain, self.merges = Tokenizer.from_file(tokenizer), _Merges.of(tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.places, self.bytes = _Places(), 0
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        fresh, self.places.fresh = self.places.fresh, []
        if not fresh:
            return
        words = [w.decode() for w in fresh]
        fast = np.array([self.merges is not None and PLAIN.fullmatch(w) is not None for w in words])
        sizes = np.zeros(len(words), np.int64)
        slow_ids = [e.ids for e in self.plain.encode_batch_fast([w for w, f in zip(words, fast) if not f], add_special_tokens=False)]
        sizes[~fast] = [len(x) for x in slow_ids]
        fast_ids, n = self.merges([w for w, f in zip(words, fast) if f]) if fast.any() else (np.zeros(0, np.uint32), 0)
        sizes[fast] = n
        made = np.zeros(int(sizes.sum()), np.uint32)
        of_fast = np.repeat(fast, sizes)
        made[of_fast], made[~of_fast] = fast_ids, np.array([x for ids in slow_ids for x in ids], np.uint32)
        self.ids = np.concatenate([self.ids, made])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.bytes += sum(map(len, fresh))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = [MARK in t for t in texts]
        words = [[] if w else t.split() for t, w in zip(texts, whole)]
        counts = np.array([len(w) for w in words], np.int64)
        place = np.fromiter((self.places[w] for held in words for w in held), np.int64, int(counts.sum()))
        self._learn()
        size = self.ends[place + 1] - self.ends[place]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.ends[place] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        bounds = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(counts)])]
        if len(self.places) > MOST_WORDS or self.bytes > MOST_BYTES:
            self._forget()
        return [
            np.array(self.plain.encode(t.decode(), add_special_tokens=False).ids, np.uint32) if w else ids[a:b]
            for t, w, a, b in zip(texts, whole, bounds, bounds[1:])
        ]


def encoder(tokenizer: str) -> WordEncoder:
    if tokenizer not in _encoders:
        _encoders[tokenizer] = WordEncoder(tokenizer)
    return _encoders[tokenizer]


def binary_cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of ``n`` ids begin, and ``n``."""
    cuts = list(range(0, n - n % capacity + 1, capacity))
    rest, digit = n % capacity, capacity >> 1
    while rest:
        if rest & digit:
            cuts.append(cuts[-1] + digit)
            rest ^= digit
        digit >>= 1
    return cuts


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int32()), ("place", pa.int64())]
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, place long"


def _cut(tokenizer: str, capacity: int, with_ids: bool):
    fields = pa.schema([*_FIELDS, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, given = encoder(tokenizer), TaskContext.get().partitionId(), dict.fromkeys((1 << k for k in range(capacity.bit_length())), 0)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, end, data, at in bytewise.pieces(batch.column(1)):
                held, out = data.tobytes(), []
                for doc_id, ids in zip(doc_ids[first:end], encode([held[a:b] for a, b in zip(at, at[1:])])):
                    ids = np.append(ids, np.uint32(CLOSING_ID)).astype("<u4")
                    cuts = binary_cuts(len(ids), capacity)
                    for a, b in zip(cuts, cuts[1:]):
                        some = ids[a:b]
                        out.append((doc_id, a, b - a, zlib.crc32(some.tobytes()), len(ids), task, given[b - a], *([some.astype(np.int32)] if with_ids else [])))
                        given[b - a] += 1
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], fields.names)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of every text with the task that made it and its place among the task's pieces of that length."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    cut = _cut(tokenizer or public_tokenizers.path(TOKENIZER), capacity, with_ids)
    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, batch_tokens: int = BATCH_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, batch[, ids].

    ``batch`` numbers the batches of a bucket from 0, so (length, batch) names one.
    """
    held = materialise(pieces(docs, capacity, tokenizer, with_ids), "binary-pieces")
    counts = held.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # A bucket's counts stand in as many rows as there are tasks, so a window may hold them.
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    first, total = {}, 0
    for length in sorted(sizes, reverse=True):
        first[length], total = total, total + sizes[length]
    bucket = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in first.items() for x in pair]), F.col("length")) if first else F.lit(0).cast("long")
    number = F.col("before") + F.col("place")
    return held.join(before, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (bucket + number).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.floor(number / F.greatest(F.lit(1), F.lit(batch_tokens) / F.col("length"))).cast("long").alias("batch"), *(["ids"] if with_ids else []),
    )
