"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concordat.llm import chat_format, components, exact_dedup, mixing, ngram_join, ordinal_quality, packing, repetition, secret_scan, storage, token_counts, warc
from concordat.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ROWS = [
    (1, None, "en", "b", None),
    (2, "", "en", None, 0),
    (3, " \t\n", None, "a", 3),
    (4, "one two", "en", "a", 7),
    (5, PROSE, "en", "a", 10),
    (5, PROSE, "en", "a", 10),
    (None, PROSE, "en", "a", 10),
    (6, PROSE.upper() + " twenty", "en", "b", 10),
    (7, "One TWO", "en", "b", 7),
    (None, None, None, None, None),
    (8, "wörter üben ß " * 3000, "de", "b", 42000),
    (9, "x" * 300_000, "en", "c", 300_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Further columns with the names that operators use inside."""
    names = ("maybe", "sha", "rank", "order", "copy", "at", "node", "sig", "block", "_part", "size", "positions", "Maybe_bits", "root")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


OPERATORS = {
    "jaccard": ngram_join.similarity_classes,
    "mixture": mixing.mixture,
    "pack": packing.pack,
    "secrets": secret_scan.secrets,
    "counts": token_counts.counts,
    "dedup": exact_dedup.exact_duplicates,
    "repetition": repetition.repetition,
    "quality": lambda d: ordinal_quality.score(d, None),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_change_nothing(docs, name):
    run = OPERATORS[name]
    drop = [c for c in ("sequence_id", "offset", "file", "start") if c in run(docs).columns and name in ("pack", "counts")]
    a, b = (Counter(map(str, run(d).drop(*drop).collect())) for d in (docs, clashing(docs)))
    assert a == b
    assert sum(a.values()) >= len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(none, name):
    assert OPERATORS[name](none).collect() == []


def test_jaccard_values(docs):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_classes(docs).collect())
    assert got[(1, 0, 1)] == got[(2, 0, 2)] == got[(3, 0, 3)] == 1
    assert got[(4, 1, 4)] == got[(7, 1, 4)] == 1  # two words each, equal in lower case
    assert got[(5, 16, 5)] == 2 and got[(None, 16, 5)] == 1 and got[(6, 17, 5)] == 1
    assert got[(None, 0, None)] == 1


def test_one_of_each_keeps_all_columns(docs):
    kept = ngram_join.one_of_each(clashing(docs))
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, None, 8, 9}
    assert kept.columns == clashing(docs).columns


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_jaccard_random_sets(spark, percent):
    """Sets that share parts of each other, at sizes and thresholds where few features are left to chance."""
    rng = np.random.default_rng(percent)
    texts = []
    for base in range(12):
        words = [f"w{base}_{i}" for i in range(rng.integers(5, 120))]
        for _ in range(6):
            mine = list(words)
            for _ in range(rng.integers(0, 4)):
                mine[rng.integers(0, len(mine))] = f"x{rng.integers(0, 10**9)}"
            texts.append(" ".join(mine[: rng.integers(max(1, len(mine) * 3 // 4), len(mine) + 1)]))
    from tests.llm.test_brute_force import similarity_classes

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_classes(docs, percent=percent).collect()}
    assert got == similarity_classes(dict(enumerate(texts)), percent=percent)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (300, 300), (None, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100}


def test_dedup_values(docs):
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got[(5, 5, 3, True)] == got[(5, 5, 3, False)] == got[(None, 5, 3, False)] == 1
    assert got[(2, 2, 3, True)] == got[(1, 2, 3, False)] == got[(None, 2, 3, False)] == 1
    kept = exact_dedup.drop_duplicates(clashing(docs))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([2, 3, 4, 5, 6, 7, 8, 9])
    assert kept.columns == clashing(docs).columns


def test_dedup_filter_has_no_false_negative(spark):
    rows = spark.range(4000).select("id", F.concat(F.lit("t"), (F.col("id") % 3000)).alias("text"))
    marked = exact_dedup.mark_possible(rows, "maybe")
    assert marked.where("id % 3000 < 1000 AND NOT maybe").count() == 0
    assert marked.where("id >= 1000 AND id < 3000 AND maybe").count() < 200


def test_mixing_values(docs):
    rows = mixing.mixture(docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.5
    again = mixing.mix(clashing(docs))
    assert again.columns == clashing(docs).columns
    assert Counter(map(str, again.collect())) == Counter(map(str, mixing.mix(clashing(docs)).collect()))


def test_mix_emits_what_is_taken(spark):
    """Sizes for which each source's target ends inside a document, and a text whose spaces have to stay as they are."""
    made = [(i, " ".join(f"w{i}_{j}" for j in range(3 + 7 * i % 40)), "en", "abc"[i % 3], i) for i in range(60)] + [(60, " \ta\n b\u000b  c ", "en", "d", 60)]
    rows = spark.createDataFrame(made, SCHEMA)
    texts = {r[0]: r[1] for r in made}
    mixed = mixing.mix(rows).collect()
    out, cut = Counter(), Counter()
    for r in mixed:
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == r["doc_id"]
        out[r["doc_id"]] += len(r["text"].split())
        cut[r["source"]] += r["text"] != texts[r["doc_id"]]
    assert sum(cut.values()) > 0 and max(cut.values()) == 1
    shares = mixing.mixture(rows).collect()
    assert {r["doc_id"]: r["taken"] for r in shares} == {k: out[k] for k in texts}
    places = {r["doc_id"]: [p["at"] for p in r["positions"]] for r in shares}
    assert sorted(places[r["doc_id"]][0] for r in mixed if len(places[r["doc_id"]]) == 1) == [places[r["doc_id"]][0] for r in mixed if len(places[r["doc_id"]]) == 1]
    got = {r["doc_id"]: r["taken"] for r in mixing.emitted(rows).collect()}
    assert got == {k: out[k] for k in texts}


def test_schedules_are_inverted(spark):
    """Demand summed up to the time that the inverse gives is the share that was asked for."""
    shares = spark.range(101).select((F.col("id") / 100).alias("s"))
    for k, points in enumerate(mixing.SCHEDULES):
        t, w = zip(*points)
        total = np.trapezoid(w, t)
        for r in shares.select("s", mixing.demand_time(F.col("s"), F.lit(k)).alias("t")).collect():
            grid = np.linspace(0, r["t"], 4001)
            assert abs(np.trapezoid(np.interp(grid, t, w), grid) / total - r["s"]) < 1e-3


def test_packed_sequences_hold_the_ids(docs):
    packed = packing.pack(docs, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert all(0 < len(r["ids"]) <= 2048 for r in rows)
    assert sum(len(r["ids"]) for r in rows) == packed.agg(F.sum("length")).first()[0]
    assert sum(x == 0 for r in rows for x in r["ids"]) >= len(ROWS)


def test_mark_strings_are_ordinary_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    t.encode_special_tokens = True
    encode = packing.encoder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    for text in ("a<|endoftext|>b", "", " " * 3000, "  x\r\n", "日本語😀", "aaaa" * 5000, "it's I'LL 1234567890"):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_secrets_by_code_point(spark):
    text = "ü😀 Password: 'abcdef' secret = x token=abc.def/+1 AKIA" + "B2" * 9 + " " + "0f" * 13
    row = secret_scan.secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (2, 1, 1)
    spans = [s.split(":") for s in row["spans"].split(",")]
    assert [text[int(a) : int(b)] for _, a, b in spans] == ["Password: 'abcdef", "token=abc.def/+1", "AKIA" + "B2" * 9, "0f" * 13]


def test_repetition_values(spark):
    text = "\n".join(["same line of words here and there again now"] * 3 + ["*#", " ", "other"])
    row = repetition.repetition(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (row[0]["n_words"], row[0]["n_dup_lines"], row[0]["n_symbols"], row[0]["n_repeat_words"]) == (29, 2, 2, 27)
    assert row[0]["base_failed"] and not row[0]["kept"] and row[1]["n_words"] == 0 and row[1]["base_failed"]


def plain_verdict(text: str) -> bool:
    """The published limits, words and windows counted one by one, first occurrences left out."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeats = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    if len(words) < 20 or 100 * len(repeats) > 30 * len(words):
        return False
    for n, limit in zip(range(5, 11), (0.15, 0.14, 0.13, 0.12, 0.11, 0.10)):
        seen, inside = set(), set()
        for i in range(len(words) - n + 1):
            window = tuple(words[i : i + n])
            if window in seen:
                inside |= set(range(i, i + n))
            seen.add(window)
        if sum(len(words[i]) for i in inside) > limit * sum(map(len, words)):
            return False
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            again += len(line) if line in seen else 0
            seen.add(line)
    return again <= 0.20 * max(len(text), 1)


def test_repetition_verdict(spark):
    """A phrase that stands from two to ten times among other words, in texts around each limit."""
    rng, texts = np.random.default_rng(8), []
    for _ in range(300):
        phrase = [f"p{i}" for i in range(rng.integers(5, 12))]
        parts = [[f"w{rng.integers(10**9)}" for _ in range(rng.integers(1, 40))] + (phrase if i else []) for i in range(rng.integers(2, 11))]
        texts.append(" ".join(w for part in parts for w in part) + rng.choice(["", "\nthe same line\nthe same line"]))
    rows = repetition.repetition(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["kept"] for r in rows}
    assert got == {i: plain_verdict(t) for i, t in enumerate(texts)}
    assert 50 < sum(got.values()) < 250


EVENTS = "conv_id long, turn long, msg int, seq int, kind string, role string, text string"


def test_event_folding(spark):
    events = [
        (1, 0, 1, 0, "message", "user", "hello"),
        (1, 0, 1, 1, "edit", None, "hello there"),
        (1, 1, 1, 0, "message", "assistant", "Ba"),
        (1, 1, 1, 1, "delta", None, "d one"),
        (1, 1, 1, 2, "regenerate", None, None),
        (1, 1, 1, 3, "delta", None, "Good"),
        (1, 1, 1, 4, "delta", None, " one </s>"),
        (1, None, 1, 0, "message", "sys\ntem\\", "<|turn|>\\<|end|>"),
        (None, 0, 1, 0, "delta", None, None),
    ]
    folded = chat_format.fold_events(spark.createDataFrame(events, EVENTS).repartition(5))
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.render(folded)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("sys\ntem\\", "<|turn|>\\<|end|>"), ("user", "hello there"), ("assistant", "Good one </s>")]
    assert back[1]["loss_text"] == "Good one </s>"
    place = back[1]["loss"][0]
    assert back[1]["formatted"][place["start"] : place["end"]] == "Good one <\\/s>"
    assert [(t["role"], t["text"]) for t in back[None]["turns"]] == [("", "")]


def test_derived_log_supersedes_drafts(spark):
    """Every message has a draft, its replacement, and events that come twice and out of order; the fold undoes all of it."""
    long_text = "".join(f"{i} ü😀 <|turn|> " for i in range(400))
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long_text), (1, None, "system", None), (2, 0, "user", "same"), (2, 0, "user", "same"), (None, 0, None, "x" * 256), (3, 5, "assistant", "")]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = plain.select("*", *[F.lit("y").alias(n) for n in ("msg", "seq", "kind", "log", "Head", "place", "turns", "loss")])
    for df in (plain, more):
        log = chat_format.conversation_events(df, chunk=16).cache()
        kinds = Counter(r["kind"] for r in log.collect())
        assert kinds["edit"] == 5 and kinds["regenerate"] == 2 and kinds["message"] == 7 and log.count() > log.distinct().count()
        folded = {(r["conv_id"], r["turn"], r["msg"]): (r["role"], r["text"]) for r in chat_format.fold_events(log).collect()}
        assert sorted(folded.items(), key=str) == sorted(
            {(1, 0, 1): ("user", "hi"), (1, 1, 1): ("assistant", long_text), (1, None, 1): ("system", ""), (2, 0, 1): ("user", "same"), (2, 0, 2): ("user", "same"),
             (None, 0, 1): ("", "x" * 256), (3, 5, 1): ("assistant", "")}.items(), key=str)
        back = {r["conv_id"]: r for r in chat_format.digests(chat_format.render(chat_format.fold_events(log))).collect()}
        assert back[1]["loss_chars"] == len(long_text) and back[2]["n_turns"] == 2 and back[None]["n_turns"] == 1
    none = chat_format.conversation_events(plain.limit(0))
    assert chat_format.digests(chat_format.render(chat_format.fold_events(none))).collect() == []


def test_a_very_long_message(spark):
    text = "\\<|end|> ü" * 60_000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat_format.digests(chat_format.render(chat_format.fold_events(chat_format.conversation_events(df)))).first()
    assert row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_log(spark):
    assert chat_format.render(chat_format.fold_events(spark.createDataFrame([], EVENTS))).collect() == []


PAGES = [
    (5, "http://a/ü b\r\nX: y", "same " * 40),
    (3, None, "same " * 40),
    (3, None, "same " * 40),
    (9, "http://c", "same " * 40),
    (4, "http://d", "short"),
    (2, "http://e", "short"),
    (7, "http://f", None),
    (None, "http://g", "ü" * 60),
    (8, "http://h", "ü" * 60),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("shard", F.lit(1))
    folder = scratch_path(spark, "warc")
    manifest = warc.write(pages, folder, file_bytes=400, shard_bytes=3000)
    rows = warc.read(manifest, folder).collect()
    got = Counter((r["page_id"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in rows)
    assert got == Counter([(3, "response", 200, None), (3, "revisit", 200, 3), (5, "revisit", 200, 3), (9, "revisit", 200, 3), (4, "response", 5, None),
                           (2, "response", 5, None), (7, "response", 0, None), (8, "response", 120, None), (None, "revisit", 120, 8)])
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in rows if r["record_type"] == "response"}[3] == "same " * 40
    again = scratch_path(spark, "warc")
    other = warc.write(pages.repartition(7), again, file_bytes=400, shard_bytes=3000)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, other.collect()))
    assert manifest.count() > 2


def test_warc_keeps_large_ids_beside_null_ones(spark):
    top = 2**62
    rows = [(top + i, None, f"{i % 7:03d} " * 40) for i in range(40)] + [(None, None, "x")] + [(i, None, "y" * 200) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = scratch_path(spark, "warc")
    read = warc.read(warc.write(pages, folder, file_bytes=300, shard_bytes=2000), folder).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in read) == Counter(
        [(top + i, "response", None) if i < 7 else (top + i, "revisit", top + i % 7) for i in range(40)]
        + [(None, "response", None), (0, "response", None), (1, "revisit", 0), (2, "revisit", 0)]
    )


def test_warc_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read(pages).collect() == []


def test_warc_parser_rejects_damage():
    held = warc.record(1, "u", b"abc", "0" * 64, 0, None, False)
    assert len(list(warc.parse(io.BytesIO(gzip.decompress(gzip.compress(held + held)))))) == 2
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(io.BytesIO(held[:-4])))


@pytest.mark.parametrize("block", [2, 6, 10, 1000])
def test_scan_stitches_blocks(spark, block):
    folder = scratch_path(spark, "tokens")
    fs, base = storage.file_system(folder)
    fs.create_dir(base, recursive=True)
    files = {"a": [1, 2, 9, 9, 3, 9, 4, 5, 6, 7, 8, 9], "b": [1, 1, 1, 1, 1], "c": [9], "d": [], "e": [9, 1]}
    for name, ids in files.items():
        with fs.open_output_stream(f"{base}/{name}") as f:
            f.write(np.array(ids, "<u2").tobytes())
    listed = spark.createDataFrame([(n, 2 * len(i)) for n, i in files.items()], "name string, bytes long")
    got = sorted((r["name"], r["ordinal"], r["n_tokens"], r["closed"]) for r in token_counts.scan(listed, folder, separator=9, block_bytes=block).collect())
    assert got == [("a", 0, 2, True), ("a", 1, 0, True), ("a", 2, 1, True), ("a", 3, 5, True), ("b", 0, 5, False), ("c", 0, 0, True), ("e", 0, 0, True), ("e", 1, 1, False)]


def test_pipeline_stages(spark, docs, sf_dir):
    """Each stage takes the columns of documents and gives them, but for the last."""
    held = docs
    for _, stage in corpus_pipeline.STAGES[1:]:
        held = stage(spark, held, sf_dir)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert held.columns == docs.columns
            held = held.persist()
    assert held.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pipeline_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    total, most = rows.agg(F.sum("length"), F.max(F.col("offset") + F.col("length"))).first()
    assert total > 0 and most <= 2048
