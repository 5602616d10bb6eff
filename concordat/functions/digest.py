"""Order-free digests of columns and rows, as SQL text.

A value gets a 60-bit fingerprint; a set of rows gets (count, sum, xor) of the
fingerprints, so no sort is needed and partial results combine in any order. The sum is
kept as three sums of 20-bit pieces: plain bigint adds inside whole-stage codegen that
stay exact up to 2**43 rows, where one decimal(38) sum would allocate per row.

Two fingerprints are on offer. ``fast`` hashes with xxhash64 and is for the engine;
``portable`` takes 15 hex digits of md5 over a canonical text, so that another SQL engine
can compute the same numbers.
"""

from __future__ import annotations

from pyspark.sql import types as T

PIECE_BITS = 20
PIECES = 3
_MASK = (1 << PIECE_BITS) - 1
_SIXTY_BITS = (1 << (PIECE_BITS * PIECES)) - 1

Typed = tuple[str, T.DataType]


def canonical_text(c: str, dtype: T.DataType) -> str:
    """One text per value, the same in any engine for integers, decimals, text and times."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BinaryType):
        return f"hex({c})"
    if isinstance(dtype, T.TimestampNTZType):
        return f"date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    if isinstance(dtype, T.TimestampType):
        return f"CAST(unix_micros({c}) AS string)"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"CAST({c} + 0D AS string)"
    return f"CAST({c} AS string)"


def _md5_hex(c: str, dtype: T.DataType) -> str:
    return f"md5(coalesce(concat('v', {canonical_text(c, dtype)}), 'n'))"


def _hex_to_bits(hex_text: str) -> str:
    return f"CAST(conv(substring({hex_text}, 1, 15), 16, 10) AS bigint)"


def portable_value(c: str, dtype: T.DataType) -> str:
    return _hex_to_bits(_md5_hex(c, dtype))


def portable_row(cols: list[Typed]) -> str:
    return _hex_to_bits(f"md5(concat({', '.join(_md5_hex(c, t) for c, t in cols)}))")


def row_hash(cols: list[Typed], seed: int = 0) -> str:
    """64 bits of a row. xxhash64 passes over nulls, so each column brings its null flag."""
    inputs = ", ".join(f"{c} IS NULL, {c}" for c, _ in cols)
    return f"xxhash64({seed}, {inputs})"


def fast_value(c: str, dtype: T.DataType) -> str:
    return fast_row([(c, dtype)])


def fast_row(cols: list[Typed]) -> str:
    return f"({row_hash(cols)} & {_SIXTY_BITS}L)"


FINGERPRINTS = {"fast": (fast_value, fast_row), "portable": (portable_value, portable_row)}


def digest_aggregates(fp: str, name: str) -> dict[str, str]:
    """Partial sums ``name_p0..p2`` and ``name_xor``, to be combined by ``digest_sum``."""
    pieces = {f"{name}_p{i}": f"sum(shiftright({fp}, {PIECE_BITS * i}) & {_MASK}L)" for i in range(PIECES)}
    return pieces | {f"{name}_xor": f"bit_xor({fp})"}


def regroup_aggregates(name: str) -> dict[str, str]:
    """Combine partial digests of disjoint row sets."""
    return {f"{name}_p{i}": f"sum({name}_p{i})" for i in range(PIECES)} | {f"{name}_xor": f"bit_xor({name}_xor)"}


def digest_sum(name: str) -> str:
    """The exact sum of all fingerprints, as decimal text."""
    parts = [
        f"CAST({name}_p{i} AS decimal(19,0)) * CAST({1 << (PIECE_BITS * i)}L AS decimal(18,0))" for i in range(PIECES)
    ]
    return f"CAST(CAST({' + '.join(parts)} AS decimal(38,0)) AS string)"


def digest_xor(name: str) -> str:
    return f"{name}_xor"
