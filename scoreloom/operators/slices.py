"""Ordered passes over grouped tables, cut into slices of bounded size.

A table is range-partitioned by (group, value), and a task orders one slice of it as
arrays. What crosses slices is only what touches their edges: the group and the run of equal
values at either end. One small row per slice carries that to the driver, two passes over
these rows give every slice its offsets, and a join by slice number applies them. The number
of slices follows the number of rows; a value that fills several slices is cut like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .staging import staged

MOST, LEAST = 250_000, 25_000  # rows of a slice on a large table, which a Python worker holds; rows worth a task of their own
FIRST_GROUP, FIRST_RUN, LAST_GROUP, LAST_RUN = 1, 2, 4, 8
PLACED = ("_before", "_run", "_size")


def slices_for(df: DataFrame, rows: int) -> int:
    return max(1, math.ceil(rows / MOST), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / LEAST)))


def group_code(by: Sequence[str]):
    """One number per group (64 bits of hash; NULL is a group of its own)."""
    return F.xxhash64(*by, *[F.isnull(c) for c in by]) if by else F.lit(0).cast("long")


def in_slices(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int, most: int | None = None) -> DataFrame:
    """``df`` in order of group and value, cut into slices (partitions) of about ``most`` rows."""
    names = [*by, *order]
    n = max(slices_for(df, rows), math.ceil(rows / most) if most else 1)
    cut = df.repartitionByRange(n, *names) if n > 1 else df.repartition(1)
    return cut.sortWithinPartitions(*names)


def mapped(df: DataFrame, work: Callable[[pa.Table, int], pa.Table], schema: T.StructType) -> DataFrame:
    """``work(slice, number)`` over every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            yield from work(pa.Table.from_batches(got), TaskContext.get().partitionId()).select(schema.names).to_batches(max_chunksize=100_000)

    return df.mapInArrow(run, schema)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row above; the first row starts too."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    if n:
        out[0] = True
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def spread(first: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each row's stretch, the stretch's weight, and the weight above the stretch, on rows."""
    spot = np.flatnonzero(first)
    total = np.add.reduceat(weights, spot)
    number = np.cumsum(first) - 1
    return number, total[number], (np.cumsum(total) - total)[number]


def _locate(value: str | None, weight: str | None):
    def work(rows: pa.Table, slice_: int) -> pa.Table:
        group = rows["_g"].to_numpy()
        w = rows[weight].to_numpy().astype(np.int64) if weight else np.ones(len(group), np.int64)
        new_group = starts(group)
        new_run = starts(group, rows[value].to_numpy()) if value else np.ones(len(group), bool)
        of_group, size, above_group = spread(new_group, w)
        of_run, run, above_run = spread(new_run, w)
        edge = FIRST_GROUP * (of_group == 0) + FIRST_RUN * (of_run == 0) + LAST_GROUP * (of_group == of_group[-1]) + LAST_RUN * (of_run == of_run[-1])
        more = {"_part": np.full(len(w), slice_, np.int64), "_edge": edge.astype(np.int64), "_before": above_run - above_group, "_run": run, "_size": size}
        for name, column in more.items():
            rows = rows.append_column(name, pa.array(column))
        return rows

    return work


def _offsets(edges: list) -> list[tuple]:
    """Per slice: what to add in its first group, weight before its first run, weights of its first and last run and group."""
    state = []
    group = value = None
    so_far = run_so_far = 0
    for e in edges:
        same = group is not None and e.g1 == group
        again = same and e.v1 == value
        base = so_far if same else 0
        before = base - run_so_far if again else base
        one_group, one_run = e.g1 == e.g2, e.g1 == e.g2 and e.v1 == e.v2
        first_run = e.r1 + (run_so_far if again else 0)
        run_so_far = first_run if one_run else e.r2
        so_far = base + e.t1 if one_group else e.t2
        group, value = e.g2, e.v2
        state.append((e, same, again, base, before, one_group, one_run, first_run, run_so_far, so_far))
    out, after = [], None  # after: (group joins on, run joins on, its first group, its first run)
    for e, same, again, base, before, one_group, one_run, first_run, last_run, size in reversed(state):
        total_last = after[2] if after and after[0] else size
        run_last = after[3] if after and after[1] else last_run
        total_first = total_last if one_group else base + e.t1
        run_first = run_last if one_run else first_run
        out.append((e["_part"], base, before, run_first, run_last, total_first, total_last))
        after = (same, again, total_first, run_first)
    return out


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str | None = None, ties: bool = True, rows: int | None = None) -> DataFrame:
    """``df`` plus, by the first name of ``order``: ``_before`` (weight of the group's rows
    below the row's value), ``_run`` (weight at that value) and ``_size`` (weight of the group).

    A row weighs 1 unless ``weight`` names a whole number. Further names of ``order`` only
    decide where slices may be cut; without ``ties`` all names together order the rows, and
    ``_before`` is the weight of the rows above. With ``rows``, their number, ``df`` is read from
    files as it is and has its groups' codes in ``_g``.
    """
    value = order[0] if ties else None
    source = df if rows is not None else staged(df.withColumn("_g", group_code(by)), "rows")
    rows = in_slices(source.withColumn("_cut", F.monotonically_increasing_id()), ["_g"], [*order, "_cut"], source.count() if rows is None else rows).drop("_cut")
    schema = T.StructType([*source.schema.fields, *[T.StructField(n, T.LongType()) for n in ("_part", "_edge", *PLACED)]])
    at = staged(mapped(rows, _locate(value, weight), schema), "placed")
    on = lambda bit, c: F.max(F.when(F.col("_edge").bitwiseAND(bit) > 0, F.col(c)))
    first, last = (on(FIRST_RUN, value), on(LAST_RUN, value)) if value else (F.max(F.col("_part") * 2), F.max(F.col("_part") * 2 + 1))  # no run crosses
    edges = at.where("_edge > 0").groupBy("_part").agg(on(FIRST_GROUP, "_g").alias("g1"), on(FIRST_GROUP, "_size").alias("t1"), first.alias("v1"), on(FIRST_RUN, "_run").alias("r1"),
                                                       on(LAST_GROUP, "_g").alias("g2"), on(LAST_GROUP, "_size").alias("t2"), last.alias("v2"), on(LAST_RUN, "_run").alias("r2"))
    found = sorted(edges.collect(), key=lambda e: e["_part"])  # a row per slice
    names = ["_part", "_base", "_b1", "_r1", "_r2", "_t1", "_t2"]
    offsets = df.sparkSession.createDataFrame(_offsets(found), ", ".join(f"{n} long" for n in names))
    edge = lambda bit: F.col("_edge").bitwiseAND(bit) > 0
    joined = at.join(offsets, "_part")
    before = F.when(edge(FIRST_RUN), F.col("_b1")).when(edge(FIRST_GROUP), F.col("_before") + F.col("_base")).otherwise(F.col("_before"))
    run = F.when(edge(LAST_RUN), F.col("_r2")).when(edge(FIRST_RUN), F.col("_r1")).otherwise(F.col("_run"))
    size = F.when(edge(LAST_GROUP), F.col("_t2")).when(edge(FIRST_GROUP), F.col("_t1")).otherwise(F.col("_size"))
    return joined.select(*df.columns, before.alias("_before"), run.alias("_run"), size.alias("_size"))
