"""Order tables for the comparison scenarios, by rule: every value follows from the row's number."""

from __future__ import annotations

import pandas as pd

REGIONS, PRODUCTS = ("north", "south", "coast"), ("bolt", "gear", "valve", "wire")


def order_table(n: int = 300, noise: float = 0.0, drop: int = 0, extra: bool = False, shuffled: bool = False) -> pd.DataFrame:
    """``noise`` moves every amount by up to that much, up and down in turn."""
    rows = []
    for i in range(n - drop):
        qty, cents = 1 + i * 37 % 90, 1000 + i * 7919 % 48_000
        revenue = qty * cents / 100 + noise * (i % 5 - 2) / 2
        rows.append((f"P-{i:05d}", REGIONS[i % 3], PRODUCTS[i * 5 % 4], float(qty), cents / 100, round(revenue, 6)))
    table = pd.DataFrame(rows, columns=["order_id", "region", "product", "qty", "unit_price", "revenue"])
    if extra:
        table["unplanned"] = "x"
    return table.iloc[sorted(table.index, key=lambda i: (i * 17 + 5) % 101)] if shuffled else table
