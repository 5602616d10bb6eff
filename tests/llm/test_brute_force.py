"""Operators that SQL cannot express, against plain Python on whole tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from concordat.llm import ngram_join, packing, secret_scan
from concordat.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def similarity_classes(texts: dict, width: int = 5, percent: int = 80) -> dict:
    sets = {}
    for k, text in texts.items():
        w = WORD.findall(text.translate(LOWER))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen = defaultdict(list)
    for k in sorted(sets):
        common = Counter(o for s in sets[k] for o in seen[s])
        for s in sets[k]:
            seen[s].append(k)
        for o, both in common.items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[o]) - both):
                a, b = root(k), root(o)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_jaccard_join(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op1_ngram_jaccard_join"](spark, sf_dir).collect()}
    assert got == similarity_classes(texts)


def test_jaccard_join_through_null_ids(spark):
    """Near copies with null ids: one bridges two documents, one hangs on another, one has only a null one beside it."""
    words = [f"w{i}" for i in range(60)]
    near = lambda mark, *changed: " ".join(f"{mark}{i}" if i in changed else mark + w for i, w in enumerate(words))
    rows = [(1, near("a", 0)), (None, near("a")), (2, near("a", 59)), (None, near("b")), (3, near("b", 0)), (None, near("c")), (None, near("c", 59)), (4, near("d"))]
    first, last = " ".join([*(f"x{i}" for i in range(5)), *words[5:]]), " ".join([*words[:-5], *(f"y{i}" for i in range(5))])
    rows += [(5, first), (None, " ".join(words)), (6, last)]
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = similarity_classes(dict(enumerate(t for _, t in rows)))
    held = defaultdict(list)
    for place, (_, group) in want.items():
        held[group].append(rows[place][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in held.items()}
    assert got == Counter((rows[place][0], least[group]) for place, (_, group) in want.items())
    assert got[6, 5] == 1 and similarity_classes({5: first, 6: last})[6][1] == 6


def repetition(text: str) -> tuple:
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def test_repetition(spark, sf_dir, texts):
    rows = QUERIES["op9_repetition_rules"](spark, sf_dir).collect()
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows}
    assert got == {k: repetition(t) for k, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert sum(r["kept"] for r in rows) > 0.6 * len(rows)


def test_packing(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for k, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, len(ids)] if len(ids) <= 2048 else [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[k, i] = (a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))
    rows = QUERIES["op4_best_fit_packing"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for _, n, _ in want.values())
    assert -(-total // 2048) <= len(bins) <= -(-total // 2048) * 1.02 + 1


@pytest.mark.parametrize("lengths", [[2048], [1025] * 9, [683] * 10, [1, 2047, 1024, 1024, 700, 700, 648], list(range(1, 2049)), [500, 600, 948] * 40])
def test_plan_packs_every_piece(lengths):
    counts = Counter(lengths)
    made = packing.plan(counts)
    got = Counter()
    for filling, bins in made:
        assert sum(n * k for n, k in filling) <= 2048
        for n, k in filling:
            got[n] += k * bins
    assert got == counts
    assert sum(b for _, b in made) <= sum(b for _, b in packing.best_fit(counts, 2048))


def test_special_strings_follow_the_tokenizer_file(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "x<|endoftext|><|endoftext|>"]
    rows = packing.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert tokenizer.encode(texts[0]).ids == [64, 220, 50256, 275]


def fewest_bins(lengths: list[int], capacity: int) -> int:
    """By trying every piece in every open bin."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(6))
def test_search_against_all_plans(seed):
    """Small instances: no bound over the optimum, nothing called proved that is not, and nearly always the optimum."""
    rng, hits = random.Random(seed), 0
    for _ in range(60):
        capacity = rng.choice([20, 50, 100])
        low = rng.choice([1, capacity // 6, capacity // 4])
        lengths = [rng.randint(low, capacity * 2 // 3) for _ in range(rng.randint(1, 10))]
        best = fewest_bins(lengths, capacity)
        found = packing.search(Counter(lengths), capacity)
        assert found.bound <= best <= found.bins
        assert not found.proved or found.bins == best
        hits += found.bins == best
    assert hits >= 59


def test_fillings_are_undominated():
    sizes = [3, 4, 5, 9, 12]
    counts = dict.fromkeys(sizes, 1)
    found, complete = packing.fillings(sizes, counts, 13, 13, keep=50)
    assert complete and [w for w, _ in found] == sorted(w for w, _ in found)
    assert found[0] == (0, ((9, 1), (4, 1)))
    # 5 + 4 + 3 is no filling: 12 fits in place of all three.
    assert all(f != ((5, 1), (4, 1), (3, 1)) for _, f in found)
    few, complete = packing.fillings(sizes, counts, 13, 13, keep=1)
    assert few == found[:1] and not complete


@pytest.mark.parametrize("lengths, most", [((300, 1000, 3000), 1.02), ((600, 760, 1500), 1.0), ((700, 1100, 1500), 1.0)])
def test_search_nears_the_bound(lengths, most):
    low, high, n = lengths
    rng = random.Random(7)
    found = packing.search(Counter(rng.randint(low, high) for _ in range(n)))
    assert found.bins <= most * found.bound


def test_plan_beats_best_fit():
    counts = Counter([900, 700, 448, 1100, 600, 348] * 3)
    assert sum(b for _, b in packing.plan(counts)) == 6


def test_quality(spark, sf_dir):
    rows = QUERIES["op6_quality_classifier"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["p_good"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)


def test_separator_scan(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op7_separator_scan"](spark, sf_dir).collect()}
    assert got == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}


def base_secrets(text: str) -> list:
    """The three patterns, scanned by hand from left to right."""
    words = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out, at = [], 0
    while m := words.search(text.translate(LOWER), at):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
        at = m.end()
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_secrets(spark, sf_dir, texts):
    names = ("assign", "access", "hex")
    rows = {r["doc_id"]: r for r in QUERIES["op5_secret_scan"](spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for k, text in texts.items():
        want = base_secrets(text)
        listed = [f"{names[kind]}:{a}:{b}" for a, kind, b in want]
        assert rows[k]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [rows[k][f"n_{n}"] for n in names] == [sum(kind == i for _, kind, _ in want) for i in range(3)]
        assert set(listed) <= set(rows[k]["spans"].split(","))


def test_inferred_grammar_knows_the_format():
    rng = random.Random(5)
    made = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    keys = ["AKIA" + made(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(400)]
    other = [made(16, "0123456789") for _ in range(400)] + [made(rng.randint(12, 20), "abcdefghij") + "1" for _ in range(400)]
    rules = secret_scan.learn({1: keys[:300]}, other[:200] + other[400:600])
    assert sum(map(rules.likely, keys[300:])) >= 95
    assert sum(map(rules.likely, other[200:400] + other[600:])) <= 4
