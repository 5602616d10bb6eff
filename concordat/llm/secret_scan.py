"""Secret scan by grammar inference.

Fixed patterns find credentials of three kinds. The strings they find are labelled examples: for each kind a
prefix tree of them is folded into a probabilistic automaton by merging states whose continuations are
statistically compatible (the Hoeffding test of ALERGIA). A further automaton is inferred from tokens of the same alphabet
that no pattern covers. Every candidate of every text is then scored. Candidates are all tokens of the alphabet and least length that
labelled ones may have, but for those inside a base span; dots at their ends are left off. One is added as a span if the
automaton of a kind finds it likely enough (as likely as nearly all examples are, per character), and far
likelier than the automaton of other tokens does. Nothing but the likelihood decides. The base spans always stay.

A first pass over the texts takes the sample that the automata are inferred from: at most ``MAX_EXAMPLES`` different strings a
kind, and as many other tokens of letters alone, with digits, and with marks, always those with the smallest hashes; each
task keeps no more. Of a string over ``MAX_LENGTH`` characters the sample has so many, and its end is not counted as one. The second pass
scores all candidates, whole; a task remembers up to ``REMEMBERED`` tokens that are none.

Places are code points, the end exclusive. Defined results: a null or empty text has no spans, zero counts, and the
digest of the empty string. Repeated rows each get a row. Other columns are not read. With fewer than
``LEAST_EXAMPLES`` examples a kind infers nothing and adds no spans. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.session import materialise

# Kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: The alphabet and least length of an assigned credential.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{4,}[A-Za-z0-9+/_=-]")
DIGIT, MARK = re.compile(r"[0-9]"), re.compile(r"[^A-Za-z0-9]")
MAX_EXAMPLES = 1500
MAX_LENGTH = 256
REMEMBERED = 300_000
LEAST_EXAMPLES = 20
ALPHA = 0.05
FLOOR = 1e-5  # chance of what a state has never seen
MARGIN = 0.25  # nats per character by which a kind has to beat other tokens
QUANTILE = 0.02  # of examples may be less likely than what is added


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, credential) of what the patterns find."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return out


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, token) of all tokens that do not lie inside a base span."""
    taken = [(a, b) for _, a, b, _ in base]
    found = ((m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text))
    return [(a, b, t) for a, b, t in found if not any(x <= a and b <= y for x, y in taken)]


@dataclass
class _State:
    passed: int = 0
    ended: int = 0
    to: dict[str, int] = field(default_factory=dict)
    count: dict[str, int] = field(default_factory=dict)


@dataclass
class Automaton:
    """Log chances of each step and of the end, by state."""

    steps: list[dict[str, tuple[int, float]]]
    ends: list[float]

    def score(self, token: str) -> float:
        """Log chance per character; past a symbol that a state has not seen it goes on from the start."""
        state, total = 0, 0.0
        for c in token:
            state, chance = self.steps[state].get(c, (0, math.log(FLOOR)))
            total += chance
        return (total + self.ends[state]) / (len(token) + 1)


def infer(examples: list[str], alpha: float = ALPHA, longest: int = MAX_LENGTH) -> Automaton:
    """Prefix tree of the examples, its states merged breadth first where they are compatible.

    Of an example over ``longest`` characters so many are taken, without an end.
    """
    states = [_State()]
    for token in examples:
        at = 0
        states[0].passed += 1
        for c in token[:longest]:
            here = states[at]
            if c not in here.to:
                here.to[c] = len(states)
                here.count[c] = 0
                states.append(_State())
            here.count[c] += 1
            at = here.to[c]
            states[at].passed += 1
        states[at].ended += len(token) <= longest
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(one: int, two: int) -> bool:
        todo = [(one, two)]
        while todo:
            a, b = (states[i] for i in todo.pop())
            if differ(a.ended, a.passed, b.ended, b.passed):
                return False
            for c in a.count.keys() | b.count.keys():
                if differ(a.count.get(c, 0), a.passed, b.count.get(c, 0), b.passed):
                    return False
                if c in a.to and c in b.to and a.to[c] != b.to[c]:
                    todo.append((a.to[c], b.to[c]))
        return True

    def fold(into: int, tree: int) -> None:
        """Add the counts of a subtree to the states it runs along, and hang on what is new."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            keep, gone = states[a], states[b]
            keep.passed += gone.passed
            keep.ended += gone.ended
            for c, child in gone.to.items():
                keep.count[c] = keep.count.get(c, 0) + gone.count[c]
                if c in keep.to:
                    todo.append((keep.to[c], child))
                else:
                    keep.to[c] = child

    settled, edge = [0], [(0, c) for c in sorted(states[0].to)]
    known = {0}
    while edge:
        source, c = edge.pop(0)
        blue = states[source].to[c]
        if blue in known:
            continue
        for red in settled:
            if compatible(red, blue):
                states[source].to[c] = red
                fold(red, blue)
                edge = [(s, x) for s in settled for x in sorted(states[s].to) if states[s].to[x] not in known]
                break
        else:
            settled.append(blue)
            known.add(blue)
            edge = [(s, x) for s in settled for x in sorted(states[s].to) if states[s].to[x] not in known]
    place = {s: i for i, s in enumerate(settled)}
    steps = [{c: (place[to], math.log(states[s].count[c] / states[s].passed)) for c, to in states[s].to.items()} for s in settled]
    ends = [math.log(max(states[s].ended / states[s].passed, FLOOR)) for s in settled]
    return Automaton(steps, ends)


@dataclass
class Grammar:
    """An automaton and a least score for each kind, and the automaton of other tokens."""

    kinds: list[tuple[Automaton, float]]
    other: Automaton | None

    def likely(self, token: str) -> bool:
        plain = self.other.score(token) if self.other else math.log(1 / 64)
        return any((s := a.score(token)) >= least and s >= plain + MARGIN for a, least in self.kinds)


def learn(labelled: dict[int, list[str]], other: list[str]) -> Grammar:
    """A kind's least score comes from the half of its examples that its first automaton has not seen."""
    kinds = []
    for _, found in sorted(labelled.items()):
        if len(found) < LEAST_EXAMPLES:
            continue
        trial, unseen = infer(found[::2]), found[1::2]
        scores = sorted(map(trial.score, unseen))
        kinds.append((infer(found), scores[int(QUANTILE * len(scores))]))
    return Grammar(kinds, infer(other) if len(other) >= LEAST_EXAMPLES else None)


#: Classes of the sample after the kinds: other tokens by what they are made of.
LETTERS, DIGITS, MARKS = 3, 4, 5


def _class_of(token: str) -> int:
    return MARKS if MARK.search(token) else DIGITS if DIGIT.search(token) else LETTERS


class _Smallest:
    """The strings with the smallest hashes of those that were offered."""

    def __init__(self, most: int):
        self.most, self.held, self.limit = most, {}, 1 << 32

    def offer(self, text: str) -> None:
        order = zlib.crc32(text.encode())
        if order <= self.limit and text not in self.held:
            self.held[text] = order
            if len(self.held) > 2 * self.most:
                self.cut()

    def cut(self) -> None:
        kept = sorted((order, text) for text, order in self.held.items())[: self.most]
        self.held = {text: order for order, text in kept}
        if len(kept) == self.most:
            self.limit = kept[-1][0]


def _sample(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = [_Smallest(most) for _ in range(6)]
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                base = base_spans(text)
                for kind, _, _, value in base:
                    classes[kind].offer(value[: MAX_LENGTH + 1])
                if base:
                    tokens = {t for _, _, t in candidates(text, base)}
                else:
                    tokens = set(CANDIDATE.findall(text))
                for token in tokens:
                    classes[_class_of(token)].offer(token[: MAX_LENGTH + 1])
        for held in classes:
            held.cut()
        rows = [(i, text, order) for i, held in enumerate(classes) for text, order in held.held.items()]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.int64()))], ["class", "value", "order"])

    return run


def grammar(docs: DataFrame, max_examples: int = MAX_EXAMPLES) -> Grammar:
    """Infer the automata from a bounded sample of the labelled strings and of other tokens."""
    found = docs.select("text").mapInArrow(_sample(max_examples), "class int, value string, order long").distinct()
    place = F.row_number().over(Window.partitionBy("class").orderBy("order", "value"))
    kept: dict[int, list[str]] = {}
    for r in materialise(found, "examples").withColumn("place", place).where(F.col("place") <= max_examples).orderBy("class", "place").collect():
        kept.setdefault(r["class"], []).append(r["value"])
    return learn({k: kept.get(k, []) for k in range(3)}, [t for k in (LETTERS, DIGITS, MARKS) for t in kept.get(k, [])])


def _report(held):
    def digest(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, unlikely = held.value, set()

        def likely(token: str) -> bool:
            if token in unlikely:
                return False
            if rules.likely(token):
                return True
            if len(unlikely) >= REMEMBERED:
                unlikely.clear()
            if len(token) <= MAX_LENGTH:
                unlikely.add(token)
            return False

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = [(a, kind, b) for kind, a, b, _ in base]
                added = []
                if any(likely(t) for t in set(CANDIDATE.findall(text)) - unlikely):
                    added = [(a, 3, b) for a, b, t in candidates(text, base) if likely(t)]
                n = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
                out.append((doc_id, *n, hashlib.sha256(digest(spans).encode()).hexdigest(), digest(spans + added), len(added)))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format."""
    held = docs.sparkSession.sparkContext.broadcast(grammar(docs))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_report(held), schema)
