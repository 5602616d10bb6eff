"""What a comparison is asked for, in small parts, and the shape of its result rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import astuple, dataclass, field
from typing import Any

from pyspark.sql import types as T

PASSED, FAILED, SKIPPED = "PASSED", "FAILED", "SKIPPED"

# Statuses above and layer labels, as saved reports have them.
LOAD = "0_load"
STRUCTURAL = "1_structural"
DATA_LEVEL = "2_data_level"
BUSINESS = "3_business_rules"
STATISTICAL = "4_statistical"

# Columns of saved check rows.
_TEXTS = ("run_id", "comparison", "layer", "check_name", "status", "message", "details")
CHECKS_SCHEMA = T.StructType(
    [*(T.StructField(n, T.StringType()) for n in _TEXTS), T.StructField("duration_ms", T.DoubleType()), T.StructField("skipped_reason", T.StringType())]
)


@dataclass(frozen=True)
class Margin:
    """How far two numbers may be apart and still count as equal."""

    absolute: float = 1e-6
    relative: float = 1e-4


@dataclass(frozen=True)
class Tolerances:
    """The margins of columns that have one of their own, and that of all others."""

    columns: Mapping[str, Margin] = field(default_factory=dict)
    others: Margin = Margin()

    def limits(self, column: str) -> tuple[float, float]:
        return astuple(self.columns.get(column, self.others))


@dataclass(frozen=True)
class Totals:
    """Columns that are added up, over all rows and, where ``within`` names columns, in each of their groups."""

    of: Sequence[str] = ()
    within: Sequence[str] = ()


@dataclass(frozen=True)
class Rule:
    """A figure that both tables have to give, to within ``margin``.

    It is measured by a SQL aggregate over the columns (``"min(revenue)"``), by a statement over ``{table}`` that gives
    one value, or by a function of the DataFrame that returns an aggregate Column, a DataFrame of one value or a scalar.
    """

    name: str
    measure: str | Callable[..., Any]
    margin: float = 0.0


@dataclass(frozen=True)
class Statistics:
    """Which figures of a column's distribution are compared, and how far they may drift, as a share."""

    quantiles: Sequence[float] = (0.50, 0.95, 0.99)
    drift: float = 0.01
    # The relative error allowed to a sketch of distinct values; without one they are counted.
    distinct_error: float | None = None
    # Order statistics work in bins of about so many rows (see operators/order_stats.py).
    rows_per_bin: int = 1_000_000


@dataclass(frozen=True)
class Samples:
    """How much of what differs a check row shows. Counts are always complete; ``Report`` gives the whole lists."""

    keys: int = 20
    rows: int = 80
    groups: int = 10


@dataclass(frozen=True)
class Comparison:
    """Everything that one comparison of two tables is asked for; each part may be left as it is.

    ``layers`` picks the layers to run, all without it; the first one is always decided, as the others need columns that fit.
    """

    key: Sequence[str] = ()
    totals: Totals = Totals()
    rules: Sequence[Rule] = ()
    tolerances: Tolerances = Tolerances()
    statistics: Statistics = Statistics()
    samples: Samples = Samples()
    ordered: bool = False
    buckets: int = 10
    layers: Sequence[str] | None = None
    name: str = "default"
    run: str = ""
    sides: tuple[str, str] = ("source", "target")

    def wants(self, layer: str) -> bool:
        return self.layers is None or layer in self.layers

    def run_name(self) -> str:
        """The name of the run, by default the time in UTC."""
        return self.run or f"{dt.datetime.now(dt.timezone.utc):%Y%m%d_%H%M%S}"
