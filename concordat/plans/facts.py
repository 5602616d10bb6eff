"""What the one profiling job found out about both sides."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Row

from concordat.config import Comparison
from concordat.operators.pairing import IS_SOURCE, Pair
from concordat.operators.profile import side_profile


@dataclass(frozen=True)
class Facts:
    rows: dict[tuple[bool, str], Row]
    duration_ms: float = 0.0

    def _get(self, is_source: bool, column: str, what: str, default=None):
        row = self.rows.get((is_source, column))
        return default if row is None else row[what]

    def row_count(self, is_source: bool) -> int:
        return max((r["rows"] for (side, _), r in self.rows.items() if side == is_source), default=0)

    def nulls(self, is_source: bool, column: str) -> int:
        return self._get(is_source, column, "nulls", 0)

    def null_ratio(self, is_source: bool, column: str) -> float:
        return self._get(is_source, column, "null_ratio", 0.0)

    def numbers(self, is_source: bool, column: str) -> int:
        return self._get(is_source, column, "numbers") or 0

    def moment(self, is_source: bool, column: str, what: str) -> float | None:
        return self._get(is_source, column, what)

    def largest(self, column: str) -> float:
        """The largest magnitude on either side, 0 without values."""
        ends = [self.moment(side, column, end) for side in (True, False) for end in ("min", "max")]
        return max((abs(e) for e in ends if e is not None), default=0.0)

    def total(self, is_source: bool, column: str, function: str) -> float | None:
        value = self._get(is_source, column, {"SUM": "total", "COUNT": "numbers", "AVG": "mean"}[function])
        return float(value) if value is not None else None if function == "AVG" else 0.0


def gather(pair: Pair, cfg: Comparison) -> Facts:
    began = time.perf_counter()
    coerced = [c for c in cfg.totals.of if c in pair.columns]
    collected = side_profile(pair, coerced).collect()
    return Facts(
        {(r[IS_SOURCE], r["column"]): r for r in collected},
        (time.perf_counter() - began) * 1000,
    )
