"""Exact tail probabilities of rank statistics for result rows of small groups.

Each function takes a column of a result table, one row per group; the counting
tables are bounded by the limits below.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNED_RANK_MOST = 50  # pairs
MANN_WHITNEY_MOST = 8  # rows of the smaller group
MANN_WHITNEY_CELLS = 10_000  # rows of one group times rows of the other


def signed_rank_upper(n: int, statistic: float) -> float:
    """P(W >= statistic) for n untied ranks with random signs."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:len(ways) - rank]
    return float(ways[int(np.ceil(statistic - 1e-9)):].sum() / 2.0**n)


def mann_whitney_lower(a: int, b: int, u: float) -> float:
    """P(U <= u) for untied groups of a and b rows."""
    # ways[j][s]: j rows of the first group with U = s, as rows of the second come in
    ways = [np.zeros(a * b + 1) for _ in range(a + 1)]
    ways[0][0] = 1.0
    for place in range(1, a + b + 1):
        for j in range(min(a, place), 0, -1):
            below = place - j  # rows of the second group below this place
            if below <= b:
                moved = np.zeros_like(ways[j])
                moved[below:] = ways[j - 1][:len(moved) - below]
                ways[j] = ways[j] + moved
    return float(ways[a][:int(np.floor(u + 1e-9)) + 1].sum() / ways[a].sum())


def exact_signed_rank(n: Column, statistic: Column) -> Column:
    """NULL beyond SIGNED_RANK_MOST pairs."""

    def tail(n: pd.Series, statistic: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_upper(int(k), s) if 0 < k <= SIGNED_RANK_MOST else None for k, s in zip(n, statistic, strict=True)], dtype="float64")

    return F.pandas_udf(tail, "double")(n, statistic)


def exact_mann_whitney(a: Column, b: Column, u: Column) -> Column:
    """NULL where neither group is small enough."""

    def tail(a: pd.Series, b: pd.Series, u: pd.Series) -> pd.Series:
        fits = [0 < min(x, y) <= MANN_WHITNEY_MOST and x * y <= MANN_WHITNEY_CELLS for x, y in zip(a, b, strict=True)]
        return pd.Series([mann_whitney_lower(int(x), int(y), v) if ok else None for ok, x, y, v in zip(fits, a, b, u, strict=True)], dtype="float64")

    return F.pandas_udf(tail, "double")(a, b, u)
