"""Ranks, positions and exact quantiles without a single-task window.

A window over a whole group (or the whole table) sends that group to one task. Here tables
are ordered slice by slice (``slices.placed``): one shuffle by range, as many slices as the
number of rows asks for, and offsets from the edges of slices. Ranks are added to the rows
where they stand, so nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numerics import dbl
from .slices import placed


def attach_one(df: DataFrame, one_row: DataFrame, *names: str) -> DataFrame:
    """Add columns of a one-row table as a scalar subquery (no join, no broadcast of data)."""
    names = names or tuple(one_row.columns)
    packed = one_row.select(F.struct(*names).alias("_one"))
    with_one = df.withColumn("_one", packed.scalar())
    return with_one.select(*df.columns, *[F.col("_one")[n].alias(n) for n in names])


def attach(df: DataFrame, small: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Add per-group columns. No broadcast hint: the runtime broadcasts the side
    it has measured to be small and splits skewed keys otherwise."""
    if by:
        return df.join(small, list(by), how)
    return attach_one(df, small)


def cumulative(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per group and distinct value: ``n`` rows there, ``cum`` rows at or
    below it, ``size`` rows in the group. ``weight`` counts a row several times."""
    by = list(by)
    amount = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    cells = placed(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(amount.alias("n")), by, [value], "n")
    return cells.select(*by, value, "n", (F.col("_before") + F.col("n")).alias("cum"), F.col("_size").alias("size"))


def rank_table(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank",
               weight: str | None = None) -> DataFrame:
    """Average rank (ties share it) of each distinct value, and the group size."""
    cells = cumulative(df, value, by, weight)
    rank = F.col("cum") - F.col("n") + (F.col("n") + 1) / dbl(2)
    return cells.select(*by, value, rank.alias(out), F.col("size").alias(f"{out}_of"))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank", weight: str | None = None) -> DataFrame:
    """Add the average rank of ``value`` and the group size ``{out}_of``; rows without a value go."""
    rows = placed(df.where(F.col(value).isNotNull()), by, [value], weight)
    rank = F.col("_before") + (F.col("_run") + 1) / dbl(2)
    return rows.select(*df.columns, rank.alias(out), F.col("_size").alias(f"{out}_of"))


def unit_ranks(df: DataFrame, names: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Add average ranks scaled to [0, 1], ``{value: out}``; 0 in groups of one."""
    out = df
    for value, name in names.items():
        scaled = F.coalesce(F.try_divide(F.col("_r") - 1, F.col("_r_of") - 1), dbl(0))
        ranked = average_rank(out, value, by, "_r")
        out = ranked.withColumn(name, scaled).drop("_r", "_r_of")
    return out.select(*df.columns, *names.values())


def unit_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "unit") -> DataFrame:
    return unit_ranks(df, {value: out}, by)


def position(df: DataFrame, value: str, key: str, by: Sequence[str] = (), out: str = "pos",
             descending: bool = False, size: str | None = None) -> DataFrame:
    """Row number by (value, key) inside each group, 1-based.

    ``value`` is numeric and ``key`` breaks ties upwards in both directions. A tie that
    holds a third of the rows is spread over slices like any other stretch.
    """
    keyed = df.withColumn("_v", F.col(value) * (-1 if descending else 1))
    rows = placed(keyed, by, ["_v", key], ties=False)
    return rows.select(*df.columns, (F.col("_before") + 1).alias(out), *([F.col("_size").alias(size)] if size else []))


def hash_position(df: DataFrame, seed, key: str, by: Sequence[str] = (), out: str = "pos",
                  size: str | None = None) -> DataFrame:
    """Position in a repeatable random order of each group."""
    from ..functions.numerics import key_hash

    hashed = df.withColumn("_h", key_hash(seed, F.col(key)))
    return position(hashed, "_h", key, by, out, size=size).drop("_h")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per share, spread over slices."""
    cells = cumulative(df, value, by)
    first = F.col("cum") - F.col("n")
    aggs = []
    for name, share in shares.items():
        spot = (F.col("size") - 1) * dbl(share)
        lo = F.floor(spot)
        for tag, at in (("lo", lo), ("hi", F.ceil(spot))):
            aggs.append(F.max(F.when((first <= at) & (at < F.col("cum")), F.col(value))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(spot - lo).alias(f"_w_{name}"))
    picked = cells.groupBy(*by).agg(F.max("size").alias("size"), *aggs)
    at = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in shares]
    return picked.select(*by, "size", *at)
