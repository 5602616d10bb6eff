"""The classifier's scores and every stage of the pipeline, each on its own input, against plain Python or SQL."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from concordat.llm import bytewise, mixing, ordinal_quality, warc
from concordat.llm.oracle import ORACLE
from concordat.session import materialise, scratch_path
from tests.llm.test_brute_force import similarity_classes
from tests.llm.test_edges import ROWS, SCHEMA, clashing

STAGE = dict(corpus_pipeline.STAGES)
ROOT = np.uint64(0x9E3779B97F4A7C15)


def _hash(token: bytes) -> int:
    data = np.frombuffer(token, np.uint8)
    return int(bytewise.span_hashes(data, np.array([0]), np.array([len(data)]), lower=True)[0])


def buckets(text: str | None) -> set[int]:
    """The features of one text, named one by one."""
    raw = (text or "").encode()
    if not raw:
        return set()
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    marks = re.findall(rb"[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", raw)
    mix = lambda x: int(bytewise.mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    hashes = [_hash(w) for w in words]
    for n in (4, 5):
        hashes += [mix(_hash(w[:n]) + n) for w in words if len(w) > n]
    hashes += [int(bytewise.span_hashes(np.frombuffer(m, np.uint8), np.array([0]), np.array([len(m)]))[0]) for m in marks]
    again = sum(a.lower() == b.lower() for a, b in zip(words, words[1:]))
    capitals = sum(65 <= b <= 90 for b in raw)
    marked = sum(map(len, marks))
    for i, (part, whole) in enumerate(((again, len(words)), (capitals, sum(map(len, words))), (len(marks), len(words)))):
        hashes.append(mix((100 * (i + 1) + 10 * min(part, whole) // max(whole, 1)) * int(ROOT)))
    assert marked >= len(marks)
    return {h >> 46 for h in hashes}


def scored(model: ordinal_quality.Model, text: str | None) -> tuple[float, float, float]:
    score = sum(float(model.weights[b]) for b in buckets(text))
    over = [1 / (1 + math.exp(float(t) - score)) for t in model.thresholds]
    return score, sum(over), over[-1]


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return ordinal_quality.train(docs, labels)


def test_scores_by_hand(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in ordinal_quality.score(docs, model).collect()}
    for r in docs.collect():
        score, grade, good = scored(model, r["text"])
        row = got.pop(r["doc_id"])
        assert (row["score"], row["expected_grade"], row["p_good"]) == pytest.approx((score, grade, good), abs=1e-4)
        assert row["kept"] == (good >= 0.5) or abs(good - 0.5) < 1e-4
    assert not got


def test_fit_separates_held_out_labels(spark):
    """Grades by what words a text has; the fit sees two thirds of them."""
    rng, rows, labels = np.random.default_rng(4), [], []
    kinds = [["vile", "hate", "foul"], ["spam", "buy", "click"], ["theorem", "proof", "lemma"]]
    for i in range(1500):
        grade = i % 3
        words = [f"w{x}" for x in rng.integers(0, 200, 30)] + list(rng.choice(kinds[grade], 4))
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(grade == 2), int(grade == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = ordinal_quality.train(docs, rated.where("doc_id < 1000"))
    held = {r["doc_id"]: r for r in ordinal_quality.score(docs.where("doc_id >= 1000"), model).collect()}
    assert model.thresholds[0] <= model.thresholds[1]
    assert sum(r["kept"] == (i % 3 == 2) for i, r in held.items()) > 0.98 * len(held)
    means = [np.mean([r["expected_grade"] for i, r in held.items() if i % 3 == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_classifier_on_odd_rows(spark, model):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    plain = Counter((r["doc_id"], round(r["score"], 3), r["kept"]) for r in ordinal_quality.score(rows, model).collect())
    assert plain == Counter((r["doc_id"], round(r["score"], 3), r["kept"]) for r in ordinal_quality.score(clashing(rows), model).collect())
    none = [r for r in ordinal_quality.score(rows, model).collect() if r["doc_id"] in (1, 2)]
    assert {r["score"] for r in none} == {0.0}
    for i, score, _ in plain:
        text = next(t for d, t, *_ in ROWS if d == i and round(scored(model, t)[0], 3) == pytest.approx(score, abs=2e-3))
        assert scored(model, text)[0] == pytest.approx(score, abs=2e-3)
    kept = ordinal_quality.select_good(clashing(rows), model)
    assert kept.columns == clashing(rows).columns and kept.count() == sum(n for (_, _, good), n in plain.items() if good)
    docs, labels = rows.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ordinal_quality.train(docs, labels) is None and ordinal_quality.train(rows, labels) is None
    assert ordinal_quality.score(rows.limit(0), model).collect() == [] and ordinal_quality.select_good(rows.limit(0), model).collect() == []
    # Labels that name no document, or with gaps, are of no use; one of several labels of a document counts for itself.
    odd = spark.createDataFrame([(99, 1, 0), (None, 1, 0), (4, None, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert ordinal_quality.train(rows, odd) is not None


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and result of each stage over the whole table."""
    held, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialise(stage(spark, held, sf_dir), "stage")
        out[name] = (held, made)
        held = made
    return out


def rows_of(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def test_classifier_stage(stages, model):
    before, after = map(rows_of, stages["quality classifier"])
    want = {i for i, r in before.items() if scored(model, r["text"])[2] >= 0.5}
    assert after.keys() == want and all(after[i] == before[i] for i in want)
    assert len(want) > 0.5 * len(before)


def test_exact_dedup_stage(stages):
    before, after = map(rows_of, stages["exact dedup"])
    largest = defaultdict(int)
    for i, r in before.items():
        largest[r["text"] or ""] = max(i, largest[r["text"] or ""])
    assert after.keys() == set(largest.values()) and all(after[i] == before[i] for i in after)


def test_near_dedup_stage(stages):
    before, after = map(rows_of, stages["n-gram Jaccard join"])
    classes = similarity_classes({i: r["text"] or "" for i, r in before.items()})
    assert after.keys() == {i for i, (_, root) in classes.items() if root == i} and all(after[i] == before[i] for i in after)


def test_mixing_stage(stages):
    before, after = stages["mixing sources to target weights"]
    assert after.columns == before.columns
    con, texts = duckdb.connect(), rows_of(before)
    con.register("documents", before.select("doc_id", "text", "source").toArrow())
    want = {i: taken for i, taken in con.execute(f"SELECT doc_id, taken FROM ({ORACLE['op3_source_mixing']})").fetchall() if taken}
    words = Counter()
    for r in after.collect():
        assert (texts[r["doc_id"]]["text"] or "").startswith(r["text"])
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == want


def test_packing_stage(stages):
    before, after = stages["best-fit packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, len(ids)] if len(ids) <= 2048 else [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    rows = after.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 2048


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_take_odd_and_no_rows(spark, sf_dir, name):
    """Nulls, empty and long texts, repeated rows, clashing columns; and an empty table."""
    docs = clashing(spark.createDataFrame(ROWS, SCHEMA))
    made = STAGE[name](spark, docs, sf_dir)
    last = name == "best-fit packing"
    assert last or made.columns == docs.columns
    assert {r["doc_id"] for r in made.select("doc_id").collect()} <= {r[0] for r in ROWS}
    assert STAGE[name](spark, docs.limit(0), sf_dir).collect() == []


def test_emitted_on_odd_rows(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    shown = lambda df: Counter(map(tuple, mixing.emitted(df).select("doc_id", "size", "source_size", "target", "taken").collect()))
    plain = shown(rows)
    assert sum(plain.values()) == len(ROWS) and shown(clashing(rows)) == plain
    assert all(taken <= 2 * size for _, size, _, _, taken in plain) and {t for i, n, _, _, t in plain if n == 0} == {0}
    con = duckdb.connect()
    unique = rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    con.register("documents", unique.select("doc_id", "text", "source").toArrow())
    want = Counter(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE['op3_source_mixing']})").fetchall())
    assert shown(unique) == want
    assert mixing.emitted(rows.limit(0)).collect() == []


def test_archives_of_odd_pages(spark):
    """Clashing names, a very long page, many null ids."""
    long = "ß<p>" * 700_000
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, None), *((None, f"http://{i}", f"text {i} " * 30) for i in range(60)), *((7, "http://c", "same " * 50) for _ in range(30))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    more = pages.select("*", *[F.lit(1).alias(n) for n in ("shard", "digest", "is_mark", "first_id", "size", "n", "bin", "pos", "start")])
    found = []
    for df in (pages, more):
        folder = scratch_path(spark, "warc")
        manifest = warc.write(df, folder, file_bytes=2000, shard_bytes=4000)
        back = warc.read(manifest, folder)
        found.append(Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back.collect()))
        texts = {r["page_id"]: bytes(r["payload"]).decode() for r in back.where("record_type = 'response' AND page_id < 4").collect()}
        assert texts == {1: long, 3: ""}
    assert found[0] == found[1] and sum(found[0].values()) == len(rows)
    assert sum(n for (i, _, _, kind, _), n in found[0].items() if i == 7 and kind == "revisit") == 29
