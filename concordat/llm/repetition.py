"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words are runs of bytes that are not white space; windows of several lengths get rolling hashes of
their word hashes. For the verdict a window whose hash stands earlier in its text covers all its words; first
occurrences are not counted, as in the published rule. The base rule counts all windows that stand twice, first included. A window of
more words repeats only where its first five do, so the longer lengths look at those places alone.

Defined results: a null or empty text has all counts 0 and fails the base rule. Ties and repeated rows are
judged row by row. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from concordat.llm import bytewise

BASE_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Published limits for the share of characters in duplicated n-grams, by n, and in repeated lines.
COVERAGE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHARS_LIMIT = 0.20

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_OWNER = np.uint64(0x9FB21C651E98DF25)

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [f"dup_{n}gram_chars" for n in COVERAGE_LIMITS] + ["dup_line_chars"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS + SHARES) + ", base_failed boolean, kept boolean"


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand more than once."""
    line = np.sort(keys)
    twice = np.unique(line[1:][line[1:] == line[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys stand at an earlier place as well."""
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return later


def _own(hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    return bytewise.mix(hashes + owners.astype(np.uint64) * _OWNER)


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words inside any of the windows that begin at ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps)[:-1] > 0


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of the texts that stand end to end in ``data``."""
    rows = len(at) - 1
    in_word, first_byte = ~bytewise.SEPARATOR[data], ~bytewise.CONTINUES[data]
    starts, ends, owners = bytewise.spans(in_word, at)
    words = bytewise.span_hashes(data, starts, ends)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first_byte, out=chars[1:])
    of_word = chars[ends] - chars[starts]

    out = {
        "n_words": np.bincount(owners, minlength=rows),
        "word_chars": np.bincount(owners, of_word, rows).astype(np.int64),
        "n_symbols": bytewise.per_text(SYMBOL[data], at),
    }

    seen_words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(in_word, out=seen_words[1:])
    begin, end, of = bytewise.spans(data != 0x0A, at)
    real = seen_words[end] > seen_words[begin]
    begin, end, of = begin[real], end[real], of[real]
    keys = _own(bytewise.span_hashes(data, begin, end), of)
    later = _again(keys)
    out["n_dup_lines"] = np.bincount(of[later], minlength=rows)
    line_chars = np.bincount(of[later], (chars[end] - chars[begin])[later], rows).astype(np.int64)

    def windows(width: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window of one text may begin, and the keys of the windows."""
        places = places[places + width <= len(words)]
        places = places[owners[places] == owners[places + width - 1]]
        total = words[places] * bytewise._FACTORS[0]
        for i in range(1, width):
            total += words[places + i] * bytewise._FACTORS[i]
        return places, _own(bytewise.mix(total), owners[places])

    short = min(min(COVERAGE_LIMITS), BASE_WINDOW)
    inside = bytewise.inside_one_text(owners, short)
    places = np.flatnonzero(inside)
    places = places[_repeated(_own(bytewise.window_hashes(words, short)[inside], owners[places]))]
    held = {}
    for n in sorted({*COVERAGE_LIMITS, BASE_WINDOW}):
        begin, keys = windows(n, places)
        held[n] = _covered(begin[_again(keys)], n, len(words))
        if n == BASE_WINDOW:
            both = _covered(begin[_repeated(keys)], n, len(words))
            out["n_repeat_words"] = np.bincount(owners[both], minlength=rows)
    for n in COVERAGE_LIMITS:
        out[f"dup_{n}gram_chars"] = np.bincount(owners[held[n]], of_word[held[n]], rows).astype(np.int64)
    out["dup_line_chars"] = line_chars

    failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    kept = ~failed & (line_chars <= LINE_CHARS_LIMIT * np.maximum((chars[at[1:]] - chars[at[:-1]]), 1))
    for n, limit in COVERAGE_LIMITS.items():
        kept &= out[f"dup_{n}gram_chars"] <= limit * out["word_chars"]
    return out | {"base_failed": failed, "kept": kept}


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [measure(data, at) for _, _, data, at in bytewise.pieces(batch.column(1))]
        if parts:
            cols = {"doc_id": batch.column(0).cast(pa.int64())}
            cols |= {k: pa.array(np.concatenate([p[k] for p in parts])) for k in parts[0]}
            yield pa.record_batch(list(cols.values()), list(cols))


def repetition(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, the characters in repeated windows and lines, base_failed, kept."""
    return docs.select("doc_id", "text").mapInArrow(_run, SCHEMA)
