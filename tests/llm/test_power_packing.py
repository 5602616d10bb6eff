"""Binary pieces against the tokenizer file, piece by piece."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concordat.llm import power_packing
from concordat.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def by_hand(texts: list[tuple], capacity: int = 4096) -> Counter:
    """(doc_id, start, length, crc, tokens) of every piece, the lengths read off the binary digits."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        lengths = [capacity] * (len(ids) // capacity) + [1 << k for k in range(40, -1, -1) if len(ids) % capacity >> k & 1]
        at = 0
        for n in lengths:
            out[doc_id, at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n])), len(ids)] += 1
            at += n
        assert at == len(ids)
    return out


def found(rows) -> Counter:
    return Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)


def test_whole_table(spark, sf_dir):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op12_power_of_two_packing"](spark, sf_dir).collect()
    assert found(rows) == by_hand(texts)
    assert all(r["offset"] == 0 for r in rows)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))


TEXTS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "It's I'LL we've 12345 don't"), (5, "one two"), (5, "one two"), (None, None),
    (6, "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> <|x"), (7, "é ́x a b c\x1cd\x85e İIΣΑΣ ΑΣ ǅ ﬁ ⅷ"), (8, "日本語 😀😀 नमस्ते ١٢٣ x²"),
    (9, "w" * 30_000), (10, " ".join(f"w{i}" for i in range(9000))), (11, "wörter üben ß " * 3000),
]


@pytest.mark.parametrize("capacity", [1, 64, 4096])
def test_odd_texts(spark, capacity):
    docs = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    rows = power_packing.pack(docs, capacity, batch_tokens=4 * capacity, with_ids=True).collect()
    assert found(rows) == by_hand(TEXTS, capacity)
    ids, buckets = defaultdict(list), defaultdict(Counter)
    for r in rows:
        assert len(r["ids"]) == r["length"] <= capacity
        buckets[r["length"]][r["batch"]] += r["length"]
        ids[r["length"]].append(r["sequence_id"])
    for length, batches in buckets.items():
        # Every batch but the last is full.
        assert sorted(batches) == list(range(len(batches)))
        assert all(batches[b] == 4 * capacity for b in range(len(batches) - 1))
        assert sorted(ids[length]) == list(range(min(ids[length]), min(ids[length]) + len(ids[length])))
    assert sorted(ids, reverse=True) == sorted(ids, key=lambda n: min(ids[n]))


def test_small_memory_of_words_changes_nothing(monkeypatch):
    texts = [t.encode() for _, t in TEXTS if t]
    path = public_tokenizers.path("word_bpe_49k.json")
    want = [x.tolist() for x in power_packing.WordEncoder(path)(texts)]
    monkeypatch.setattr(power_packing, "MOST_WORDS", 3)
    small = power_packing.WordEncoder(path)
    assert [small([t])[0].tolist() for t in texts] == want
    assert small([]) == []


def test_fast_way_equals_the_tokenizer():
    """Every entry of the vocabulary, every plain character beside others, and random words."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(3)
    held = [t.removesuffix("</w>") for t in tokenizer.get_vocab()]
    letters = power_packing._byte_letters()
    words = [bytes(letters[c] for c in t if c in letters).decode(errors="ignore") for t in held]
    plain = [c for c in map(chr, range(33, 0x300)) if power_packing.PLAIN.fullmatch(c)]
    words += [w for c in plain for w in (c, f"a{c}", f"{c}B", f"É{c}1", f"'{c}s'll{c}", c * 3)]
    words += ["".join(rng.choice(words[:40_000]) for _ in range(rng.randint(1, 4))) for _ in range(40_000)]
    words += ["".join(rng.choice(plain) for _ in range(rng.randint(1, 12))) for _ in range(40_000)]
    words = [w for w in words if power_packing.PLAIN.fullmatch(w)]
    assert len(words) > 100_000
    ids, sizes = power_packing._Merges.of(path)(words)
    at = 0
    for w, n, made in zip(words, sizes, tokenizer.encode_batch_fast(words, add_special_tokens=False)):
        assert (ids[at : at + n].tolist() if "<|" not in w else made.ids) == made.ids, w
        at += n
    assert at == len(ids)


def test_other_files_take_the_tokenizer(tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        changed = f.read().replace('"Lowercase"', '"Strip","strip_left":true,"strip_right":true', 1)
    other = tmp_path / "other.json"
    other.write_text(changed)
    encode, tokenizer = power_packing.WordEncoder(str(other)), Tokenizer.from_file(str(other))
    assert encode.merges is None
    assert encode([b"One TWO, three"])[0].tolist() == tokenizer.encode("One TWO, three", add_special_tokens=False).ids


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    more = docs.select("*", *[F.lit(1).alias(n) for n in ("task", "place", "length", "n", "before", "Start", "ids", "batch")])
    assert found(power_packing.pack(more).collect()) == found(power_packing.pack(docs).collect())
    assert power_packing.pack(docs.limit(0)).collect() == []


def test_capacity_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        power_packing.pack(spark.createDataFrame([(1, "a")], SCHEMA), 3000)
