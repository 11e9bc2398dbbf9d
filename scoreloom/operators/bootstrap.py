"""Resampling with draws that depend on keys only.

A task takes a range of draws of one group (``resampled``). It holds the group's rows as codes of
12 to 36 bytes each, works out a draw's picks from their hashes, and only the sums of a draw leave it: what
is shuffled grows with the rows, not with rows times draws. Groups of more than ``ROWS_AT_ONCE`` rows
go another way (``draws``, ``scores``): a unit carries one vector of how often every draw takes it, and passes
over slices of the ordered table work out weighted ranks and sums of all draws side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.hashing import picks as hashed_picks
from ..functions.numerics import dbl, key_hash
from .ranking import attach_one, position
from .slices import group_code, in_slices, mapped, starts
from .staging import staged

VECTOR_BYTES = 32 << 20  # of the vectors that a task holds at once
TOGETHER = 250  # draws worked out side by side
ROWS_AT_ONCE = 20_000_000  # of a group whose draws one task works out, in 36 bytes a row
LEAN = 3  # times as many where no errors are asked for, in 12 bytes a row, if none of its tables has more than ROWS_AT_ONCE
PICKS_AT_ONCE = 1 << 20
HASHES, SPARE = 2.0**60, 12.0
SCORES = ("srcc", "plcc", "mae", "rmse", "auroc")
SUMS = ("w", "wx", "wy", "wxy", "wxx", "wyy", "x", "y", "xx", "yy", "xy", "gap", "gap2", "good", "goodx")


def indexed(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with a dense index ``idx`` (from 0) by key and the group size ``n``."""
    placed = position(df, key, key, by, "idx", size="n")
    return placed.withColumn("idx", F.col("idx") - 1)


def counted(picks: DataFrame, keys: Sequence[str], width: int, units: int, repeat: str = "rep") -> DataFrame:
    """``keys`` and ``times`` (16-bit counts per draw, packed) from one row per pick of a draw below ``width``."""
    keys = list(keys)
    parts = max(1, math.ceil(units * width * 8 / VECTOR_BYTES), min(units, picks.sparkSession.sparkContext.defaultParallelism))

    def count(rows: pa.Table, _: int) -> pa.Table:
        code, first, unit = np.unique(rows["_g"].to_numpy(), return_index=True, return_inverse=True)
        times = np.bincount(unit * width + rows["_rep"].to_numpy(), minlength=len(code) * width).astype(np.uint16).reshape(len(code), width)
        return rows.select(keys).take(pa.array(first)).append_column("times", pa.array([v.tobytes() for v in times]))

    named = picks.select(*keys, F.col(repeat).cast("long").alias("_rep"), group_code(keys).alias("_g"))
    schema = T.StructType([*picks.select(*keys).schema.fields, T.StructField("times", T.BinaryType())])
    return mapped(named.repartition(parts, "_g"), count, schema)


def draws(units: DataFrame, key: str, repeats: int, seed, by: Sequence[str] = ()) -> DataFrame:
    """``by``, key, n and ``times``: how often each of ``repeats`` draws with replacement takes a unit,
    after a first entry of 1 for the table as it is.

    Draw d of repeat b picks the unit hash(seed, b, d) mod n in order of keys, so groups of the same
    units have the same draws, whatever else is in the table.
    """
    by = list(by)
    rows = staged(indexed(units.select(*by, key).distinct(), key, by), "units")
    slots = rows.select(*by, "idx", "n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    picks = slots.select(*by, "rep", (key_hash(seed, F.col("rep"), F.col("idx")) % F.col("n")).alias("idx")).withColumn("rep", F.col("rep") + 1)
    whole = rows.select(*by, F.lit(0).alias("rep"), "idx")
    times = counted(picks.unionByName(whole), [*by, "idx"], repeats + 1, rows.count())
    return rows.join(times, [*by, "idx"]).select(*by, key, "n", "times")


def _matrix(rows: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows["times"].to_pylist()), np.uint16).reshape(len(rows), width)


def _mid_ranks(times: np.ndarray, runs: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Average rank of every row in every draw, within its group of this slice; ``runs`` and ``groups`` mark first rows."""
    upto = np.cumsum(times, axis=0, dtype=np.float64)
    above = np.vstack((np.zeros((1, times.shape[1])), upto[:-1]))
    run, group = np.cumsum(runs) - 1, np.cumsum(groups) - 1
    first = np.flatnonzero(runs)
    last = np.append(first[1:], len(runs)) - 1
    before = above[first] - above[np.flatnonzero(groups)][group[first]]
    return (before + (upto[last] - above[first] + 1) / 2)[run]


def _group_totals(times: np.ndarray, groups: np.ndarray) -> np.ndarray:
    return np.add.reduceat(times.astype(np.float64), np.flatnonzero(groups), axis=0)


def _ahead(totals: DataFrame, width: int) -> DataFrame:
    """``_g``, ``_part``, ``ahead``: the draws' weight of the group in the slices before. A row per slice and group."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["_part"].to_numpy())
        rows = rows.take(pa.array(order))
        t = np.frombuffer(b"".join(rows["total"].to_pylist()), np.float64).reshape(len(rows), width)
        return pa.table({"_g": rows["_g"], "_part": rows["_part"], "ahead": pa.array([v.tobytes() for v in np.cumsum(t, axis=0) - t])})

    several = totals.join(totals.groupBy("_g").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_g"), "_g")
    return several.groupBy("_g").applyInArrow(run, "_g long, _part long, ahead binary")


def scores(rows: DataFrame, by: Sequence[str], x: str, y: str, width: int, good: float | None = None) -> DataFrame:
    """Per group and draw (``rep`` below ``width``): n, srcc, plcc, mae, rmse and, with a bound ``good``
    on ``y``, the auroc of ``x`` for rows at or above it.

    ``rows`` has ``times`` of the row's unit. Coefficients are NULL below three rows or where a
    side doesn't vary. Rows without x or y take no part; a value is cut between slices never.
    """
    by = list(by)
    most = max(1, VECTOR_BYTES // (2 * width))
    source = staged(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, group_code(by).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), "times"), "drawn")
    n = source.count()
    long, double, binary = T.LongType(), T.DoubleType(), T.BinaryType()

    def rank_y(table: pa.Table, slice_: int) -> pa.Table:
        group = table["_g"].to_numpy()
        groups, runs = starts(group), starts(group, table["_y"].to_numpy())
        times = _matrix(table, width)
        ranks = np.empty(times.shape, np.float64)
        for lo in range(0, width, TOGETHER):
            ranks[:, lo:lo + TOGETHER] = _mid_ranks(times[:, lo:lo + TOGETHER], runs, groups)
        totals, first = _group_totals(times, groups), np.flatnonzero(groups)
        total: list = [None] * len(table)
        for t, row in zip(totals, first.tolist(), strict=True):
            total[row] = t.tobytes()
        return table.append_column("_part", pa.array(np.full(len(table), slice_, np.int64))).append_column("_ry", pa.array([v.tobytes() for v in ranks])).append_column("total", pa.array(total, pa.binary()))

    kind = T.StructType([*source.schema.fields, T.StructField("_part", long), T.StructField("_ry", binary), T.StructField("total", binary)])
    by_y = staged(mapped(in_slices(source, by, ["_y"], n, most), rank_y, kind), "by-y")
    ahead = _ahead(by_y.where("total is not null").select("_g", "_part", "total"), width)
    both = staged(by_y.drop("total").join(ahead, ["_g", "_part"], "left").drop("_part"), "ranked")

    def sum_up(table: pa.Table, slice_: int) -> pa.Table:
        group, vx, vy = (table[c].to_numpy() for c in ("_g", "_x", "_y"))
        groups, runs, first = starts(group), starts(group, vx), None
        first = np.flatnonzero(groups)
        times = _matrix(table, width)
        out = {c: np.empty((len(first), width)) for c in SUMS}
        ry_all, ahead_all = table["_ry"].to_pylist(), table["ahead"].to_pylist()
        facts = {"x": vx, "y": vy, "xx": vx * vx, "yy": vy * vy, "xy": vx * vy, "gap": np.abs(vx - vy), "gap2": (vx - vy) ** 2, "good": (vy >= good).astype(float) if good is not None else np.zeros(len(vy))}
        for lo in range(0, width, TOGETHER):
            cut = slice(lo, lo + TOGETHER)
            m = times[:, cut].astype(np.float64)
            rx = _mid_ranks(times[:, cut], runs, groups)
            part = lambda v: np.frombuffer(v, np.float64)[cut]  # noqa: E731, B023
            ry = np.array([part(v) if a is None else part(v) + part(a) for v, a in zip(ry_all, ahead_all, strict=True)])
            add = lambda v: np.add.reduceat(v, first, axis=0)
            mx, my = m * rx, m * ry
            for name, v in (("w", m), ("wx", mx), ("wy", my), ("wxy", mx * ry), ("wxx", mx * rx), ("wyy", my * ry), ("goodx", mx * facts["good"][:, None])):
                out[name][:, cut] = add(v)
            for name, v in facts.items():
                out[name][:, cut] = add(m * v[:, None])
        small = table.select([*by, "_g"]).take(pa.array(first)).append_column("_part", pa.array(np.full(len(first), slice_, np.int64)))
        for name in SUMS:
            small = small.append_column(name, pa.array([v.tobytes() for v in out[name]]))
        return small

    keys = both.select(*by, "_g").schema.fields
    kind = T.StructType([*keys, T.StructField("_part", long), *[T.StructField(c, binary) for c in SUMS]])
    sums = staged(mapped(in_slices(both, by, ["_x"], n, most), sum_up, kind), "sums")

    def finish(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["_part"].to_numpy())))
        v = {c: np.frombuffer(b"".join(table[c].to_pylist()), np.float64).reshape(len(table), width) for c in SUMS}
        up = np.cumsum(v["w"], axis=0) - v["w"]  # weight in the slices before
        wx, wxy, wxx = v["wx"] + up * v["w"], v["wxy"] + up * v["wy"], v["wxx"] + 2 * up * v["wx"] + up * up * v["w"]
        s = {c: a.sum(axis=0) for c, a in (v | {"wx": wx, "wxy": wxy, "wxx": wxx, "goodx": v["goodx"] + up * v["good"]}).items()}
        k = s["w"]
        with np.errstate(all="ignore"):
            coefficient = lambda a, b, ab, aa, bb: _coefficient(k, s[a], s[b], s[ab], s[aa], s[bb])
            pos, neg = s["good"], k - s["good"]
            auc = np.where((pos > 0) & (neg > 0), (s["goodx"] - pos * (pos + 1) / 2) / (pos * neg), np.nan)
            columns = {"n": k.astype(np.int64), "srcc": coefficient("wx", "wy", "wxy", "wxx", "wyy"), "plcc": coefficient("x", "y", "xy", "xx", "yy"),
                       "mae": s["gap"] / k, "rmse": np.sqrt(s["gap2"] / k), "auroc": auc}
        first = table.select(by).take(pa.array(np.zeros(width, np.int64))) if by else pa.table({"rep": pa.array(np.arange(width))})
        out = first.append_column("rep", pa.array(np.arange(width))) if by else first
        for name, c in columns.items():
            out = out.append_column(name, pa.array(c) if name == "n" else pa.array(c, mask=~np.isfinite(c)))
        return out

    kind = T.StructType([*both.select(*by).schema.fields, T.StructField("rep", long), T.StructField("n", long), *[T.StructField(c, double) for c in ("srcc", "plcc", "mae", "rmse", "auroc")]])
    return sums.groupBy("_g").applyInArrow(finish, kind).where("n > 0")


class _Cells:
    """Rows of one table in order of x, for sums under any weights of the units."""

    def __init__(self, unit: np.ndarray, x: np.ndarray, y: np.ndarray, errors: bool, good: float | None):
        order = np.argsort(x, kind="stable")
        x, y, self.unit = x[order], y[order], unit[order].astype(np.int32)
        self.first = np.flatnonzero(starts(x))
        uy, code = np.unique(y, return_inverse=True)
        self.code, self.n_y = code.astype(np.int32), len(uy)
        self.from_good = None if good is None else int(np.searchsorted(uy, good))
        self.facts = None
        if errors:  # both sides moved by a mean, which no coefficient minds
            gap, mx, my = np.abs(x - y), x.mean(), y.mean()
            self.ux, self.uy = x[self.first] - mx, uy - my
            self.facts = np.vstack(((x - mx) * (y - my), gap, gap * gap))

    def sums(self, times: np.ndarray) -> tuple[float, ...]:
        """n, srcc, plcc, mae, rmse, auroc where unit u counts ``times[u]`` times; ranks are taken from their mean."""
        m = times[self.unit]
        wx, wy = np.add.reduceat(m, self.first), np.bincount(self.code, m, self.n_y)
        k = wx.sum()
        rx, ry = (np.cumsum(w) - w + (w - k) / 2 for w in (wx, wy))
        srcc = _coefficient(k, 0.0, 0.0, rx @ np.add.reduceat(m * ry[self.code], self.first), wx @ (rx * rx), wy @ (ry * ry))
        plcc = mae = rmse = auroc = np.nan
        if self.facts is not None:
            xy, gap, gap2 = self.facts @ m
            plcc = _coefficient(k, wx @ self.ux, wy @ self.uy, xy, wx @ (self.ux * self.ux), wy @ (self.uy * self.uy))
            mae, rmse = gap / k if k else np.nan, math.sqrt(gap2 / k) if k else np.nan
        if self.from_good is not None:
            of_good = np.add.reduceat(m * (self.code >= self.from_good), self.first)
            pos = of_good.sum()
            if 0 < pos < k:
                auroc = ((rx + (k + 1) / 2) @ of_good - pos * (pos + 1) / 2) / (pos * (k - pos))
        return k, srcc, plcc, mae, rmse, auroc


def _of_tasks(batches: Iterator[pa.RecordBatch], keep) -> Iterator[tuple[int, dict]]:
    """Task number and its cells by table number, from rows in order of both."""
    task, cells, held, table = None, {}, [], None

    def close():
        if held:
            unit, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            cells[table] = keep(unit, x, y)

    for batch in batches:
        tasks, tables, *columns = (batch[c].to_numpy() for c in ("_task", "_w", "_unit", "_x", "_y"))
        edges = np.append(np.flatnonzero(starts(tasks, tables)), len(tasks))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if (tasks[lo], tables[lo]) != (task, table):
                close()
                if cells and tasks[lo] != task:
                    yield task, cells
                    cells = {}
                task, table = int(tasks[lo]), int(tables[lo])
            held.append([c[lo:hi].copy() for c in columns])
    close()
    if cells:
        yield task, cells


def resampled(rows: DataFrame, key: str, by: Sequence[str], within: Sequence[str], x: str, y: str, repeats: int, seed,
              errors: bool = False, good: float | None = None, min_units: int = 1) -> DataFrame:
    """The scores of every draw (``rep`` from 1; 0 is the table as it is): by, within, rep, units, n, srcc and, with ``errors``, plcc,
    mae, rmse; with ``good`` the auroc of x for rows with y at or above it.

    Units (``key``) are drawn per group of ``by`` as by ``draws``, with all their rows; a score is one of a table of
    ``within``. Groups of fewer than ``min_units`` units are left out. Rows without x or y take no part.
    """
    spark, within = rows.sparkSession, list(within)
    if not by:
        return resampled(rows.withColumn("_all", F.lit(0)), key, ["_all"], within, x, y, repeats, seed, errors, good, min_units).drop("_all")
    by = list(by)
    source = staged(rows.select(*by, *within, key, group_code(within).alias("_w"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "resampled")
    units = indexed(source.select(*by, key).distinct(), key, by).where(F.col("n") >= min_units).select(*by, key, F.col("idx").cast("int").alias("_unit"), F.col("n").alias("units"))
    placed = staged(source.where("_x is not null and _y is not null").join(units, [*by, key]), "units-of-rows")
    tables = placed.groupBy(*by, "_w").agg(F.count(F.lit(1)).alias("_n"), F.max("units").alias("units"))
    groups = tables.groupBy(*by).agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_most"), F.max("units").alias("units"))
    lean = (F.col("_rows") <= LEAN * ROWS_AT_ONCE) & (F.col("_most") <= ROWS_AT_ONCE) if not errors and good is None else F.lit(False)
    groups = staged(groups.withColumn("_fits", (F.col("_rows") <= ROWS_AT_ONCE) | lean).drop("_most"), "groups")  # a row per group
    kind = {**dict.fromkeys(("_w", "rep", "n"), T.LongType()), **dict.fromkeys(SCORES, T.DoubleType())}

    fits = groups.where("_fits")
    wanted = spark.sparkContext.defaultParallelism  # tasks in all, as every task of a group gets its rows
    total = fits.agg(F.sum("_rows")).first()[0] or 1
    parts = F.least(F.lit(repeats + 1), F.greatest(F.lit(1), F.floor(F.col("_rows") * wanted / total))).cast("int")
    shares = fits.withColumn("_parts", parts).withColumn("_from", F.sum("_parts").over(Window.orderBy(*by)) - F.col("_parts"))
    shares = staged(shares.select(*by, F.col("_from").cast("int"), "_parts", "units"), "shares")
    work = {r["_from"] + i: (r["_from"], r["units"], i * (repeats + 1) // r["_parts"], (i + 1) * (repeats + 1) // r["_parts"])
            for r in shares.select("_from", "_parts", "units").collect() for i in range(r["_parts"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, cells in _of_tasks(batches, lambda unit, x, y: _Cells(unit, x, y, errors, good)):
            group, n, low, high = work[task]
            found = []
            step = max(1, PICKS_AT_ONCE // n)
            for lo in range(low, high, step):
                reps = range(lo, min(lo + step, high))
                drawn = iter(hashed_picks(seed, [r - 1 for r in reps if r], n))
                for rep in reps:
                    times = np.bincount(next(drawn), minlength=n).astype(np.float64) if rep else np.ones(n)
                    found += [(table, rep, *c.sums(times)) for table, c in cells.items()]
            columns = dict(zip(("_w", "rep", "n", *SCORES), (np.array(c) for c in zip(*found, strict=True)), strict=True))
            arrays = [pa.array(columns[c].astype(np.int64)) if t == T.LongType() else pa.array(columns[c].astype(np.float64), mask=~np.isfinite(columns[c])) for c, t in kind.items()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), group, np.int32)), *arrays], ["_from", *kind])

    dealt = placed.join(shares.drop("units"), by).select(F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_parts") - 1)).alias("_task"), "_w", "_unit", "_x", "_y")
    dealt = dealt.repartitionById(max(1, min(len(work), 2 * wanted)), F.col("_task")).sortWithinPartitions("_task", "_w")
    schema = T.StructType([T.StructField("_from", T.IntegerType()), *[T.StructField(c, t) for c, t in kind.items()]])
    done = staged(dealt.mapInArrow(run, schema), "drawn-scores")
    tables = placed.select(*by, *within, "_w").distinct().join(shares.drop("_parts"), by)
    out = done.join(tables, ["_from", "_w"]).where("n > 0").select(*by, *within, "rep", "units", "n", *SCORES)

    large = groups.where("not _fits").drop("_fits")
    if large.isEmpty():
        return out
    some = source.join(large.select(*by), by, "left_semi")
    drawn = staged(draws(some.select(*by, key), key, repeats, seed, by), "times")
    rest = scores(some.join(drawn.drop("n"), [*by, key]), [*by, *within], "_x", "_y", repeats + 1, good).join(large.drop("_rows"), by)
    return out.unionByName(rest.select(*out.columns))


def _coefficient(n, a, b, ab, aa, bb) -> np.ndarray:
    va, vb = aa - a * a / n, bb - b * b / n
    tiny = 1e-12
    flat = (n < 3) | (va <= tiny * np.abs(aa)) | (vb <= tiny * np.abs(bb))
    return np.where(flat, np.nan, (ab - a * b / n) / np.sqrt(np.where(flat, 1.0, va * vb)))


def interval(df: DataFrame, value: str, by: Sequence[str], level: float = 0.95, min_draws: int = 30) -> DataFrame:
    """Percentile interval over repeats (one row per repeat and group, a fixed number);
    undefined repeats are left out, NULL with fewer than ``min_draws`` good ones."""
    tail = (1 - level) / 2
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    cut = good.groupBy(*by).agg(F.count(F.lit(1)).alias("draws"), F.percentile(value, [tail, 1 - tail]).alias("_ci"))
    enough = F.col("draws") >= min_draws
    return cut.select(*by, "draws", F.when(enough, F.col("_ci")[0]).alias("ci_low"), F.when(enough, F.col("_ci")[1]).alias("ci_high"))


def holm(df: DataFrame, p: str = "p_value", key: str = "arm", out: str = "p_holm") -> DataFrame:
    """Step-down correction ``min(p * (m - rank), 1)`` by ascending p over a table of
    test results (one row per arm); not forced to be monotone."""
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(p, key)) - 1
    m = F.count(F.lit(1)).over(everything)
    return df.withColumn(out, F.least(F.col(p) * (m - rank), dbl(1)))


def weighted(per: DataFrame, by: Sequence[str], value: str = "srcc", out: str = "w") -> DataFrame:
    """The weighted sum over dimensions of every draw; NULL where a dimension has no value."""
    from .agreement import DIMENSION_WEIGHTS, weighted_over_dimensions

    whole = per.groupBy(*by, "rep").agg(F.count(value).alias("_d")).where(F.col("_d") == len(DIMENSION_WEIGHTS)).select(*by, "rep")
    return weighted_over_dimensions(per, [*by, "rep"], {value: out}).join(whole, [*by, "rep"], "left_semi")


def paired_deltas(rows: DataFrame, baseline: str, repeats: int, seed, min_units: int = 30, min_draws: int = 100) -> DataFrame:
    """Every arm against ``baseline`` on their common images: arm, n_common, baseline_wsrcc, arm_wsrcc,
    delta, ci_low, ci_high, p_positive, sd, draws. Both sides of a draw use the same images.

    ``rows``: image_id, dimension, arm, pred, gt. Arms with fewer common images or draws are left out.
    """
    keys = ["image_id", "dimension"]
    base = rows.where(F.col("arm") == baseline).select(*keys, F.col("pred").alias("base"))
    pairs = staged(rows.where(F.col("arm") != baseline).join(base, keys), "pairs")
    both = F.inline(F.array(F.struct(F.lit(False).alias("is_base"), F.col("pred").alias("value")), F.struct(F.lit(True).alias("is_base"), F.col("base").alias("value"))))
    per = staged(resampled(pairs.select(*keys, "arm", "gt", both), "image_id", ["arm"], ["is_base", "dimension"], "value", "gt", repeats, seed, min_units=min_units), "scores")
    w = weighted(per, ["arm", "is_base"])
    side = lambda flag, name: w.where(F.col("is_base") == flag).select("arm", "rep", F.col("w").alias(name))
    delta = staged(side(False, "mine").join(side(True, "theirs"), ["arm", "rep"]).withColumn("delta", F.col("mine") - F.col("theirs")), "deltas")
    point = delta.where("rep = 0").select("arm", F.col("theirs").alias("baseline_wsrcc"), F.col("mine").alias("arm_wsrcc"), F.col("delta").alias("delta"))
    spread = delta.where("rep > 0").groupBy("arm").agg(F.count("delta").alias("draws"), F.percentile("delta", [0.025, 0.975]).alias("_ci"),
                                                       F.avg((F.col("delta") > 0).cast("int")).alias("p_positive"), F.stddev_pop("delta").alias("sd"))
    size = per.groupBy("arm").agg(F.max("units").alias("n_common"))
    out = size.join(point, "arm").join(spread.where(F.col("draws") >= min_draws), "arm")
    return out.select("arm", "n_common", "baseline_wsrcc", "arm_wsrcc", "delta", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"), "p_positive", "sd", "draws")


def subsamples(units: DataFrame, stratum: str, key: str, sizes: Sequence[int], repeats: int, seed) -> DataFrame:
    """key, ``rep`` (place of the size times ``repeats`` plus the draw): proportional stratified subsamples
    without replacement. Of each stratum the share of n, rounded half to even and 1 at least, in a random
    order of the draw; what is above n in all goes in a second random order. Sizes above the number of units are left out.
    """
    most = max(sizes) + 1
    rows = staged(units.select(stratum, key), "units")
    total = rows.count()
    # Hashes are even on [0, 2 ** 60): below the bound lie the first ``most`` of a stratum and SPARE standard deviations more.
    strata = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bound", F.lit((most + SPARE * math.sqrt(most)) * HASHES) / F.col("_n"))
    strata = staged(strata, "strata")
    draw = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_d")
    spread = rows.select(stratum, key, draw).withColumn("_h", key_hash(seed, F.col("_d"), F.col(key)))
    early = staged(spread.join(strata, stratum).where(F.col("_h") < F.col("_bound")).drop("_n", "_bound"), "early")
    counts = early.groupBy("_d", stratum).agg(F.count(F.lit(1)).alias("_k"))
    short = strata.select(stratum, "_n", draw).join(counts, ["_d", stratum], "left").where(F.coalesce("_k", F.lit(0)) < F.least("_n", F.lit(most)))
    short = staged(short.select("_d", stratum), "short")
    if not short.isEmpty():  # these draws order their whole stratum
        early = early.join(short, ["_d", stratum], "left_anti").unionByName(spread.join(short, ["_d", stratum], "left_semi"))
    order = F.row_number().over(Window.partitionBy("_d", stratum).orderBy("_h", key))
    first = early.withColumn("_pos", order).where(F.col("_pos") <= most)
    quota = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")).withColumn("_size", F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(n).alias("n")) for i, n in enumerate(sizes) if n <= total] or [F.struct(F.lit(0).alias("nth"), F.lit(0).alias("n"))])))
    quota = quota.select(stratum, "_size.*", F.greatest(F.lit(1), F.bround(F.col("_n") / F.lit(total) * F.col("n"))).alias("_take")).where("n > 0")
    taken = first.join(quota, stratum).where(F.col("_pos") <= F.col("_take"))
    trim = F.row_number().over(Window.partitionBy("nth", "_d").orderBy(key_hash(seed, F.lit("trim"), F.col("_d"), F.col(key)), key))  # n and a few rows
    return taken.withColumn("_t", trim).where(F.col("_t") <= F.col("n")).select(key, (F.col("nth") * repeats + F.col("_d")).alias("rep"))


def _plain_scores(rows: DataFrame, picks: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, rep, srcc of ``pred`` and ``gt`` over the images that ``picks`` takes in a draw; these are few."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["_w"].to_numpy(), kind="stable")))
        w, x, y = (table[c].to_numpy() for c in ("_w", "_x", "_y"))
        edges = np.append(np.flatnonzero(starts(w)), len(w)).tolist()
        values = np.array([_Cells(np.arange(hi - lo), x[lo:hi], y[lo:hi], False, None).sums(np.ones(hi - lo))[1] for lo, hi in zip(edges[:-1], edges[1:], strict=True)], np.float64)
        return pa.table({"_w": w[edges[:-1]], "rep": table["rep"].take(pa.array(edges[:-1])), "srcc": pa.array(values, mask=~np.isfinite(values))})

    coded = rows.where("pred is not null and gt is not null").select("image_id", group_code(by).alias("_w"), F.col("pred").cast("double").alias("_x"), F.col("gt").cast("double").alias("_y"))
    coded = coded.join(picks.select("image_id", F.col("rep").cast("long").alias("rep")), "image_id").drop("image_id")
    names = rows.select(*by, group_code(by).alias("_w")).distinct()
    return coded.groupBy("rep").applyInArrow(run, "_w long, rep long, srcc double").join(names, "_w").drop("_w")


def power_curve(rows: DataFrame, bucket, sizes: Sequence[int], repeats: int, seed, min_images: int = 100) -> DataFrame:
    """n, arm, draws, mean, sd, ci_width, win_share: the weighted coefficient on subsamples of growing size.

    ``rows``: image_id, dimension, arm, pred, gt. Arms with fewer than ``min_images`` images are left out; images
    are those that all others have, in strata of ``bucket(gt)`` of dimension overall. A draw is won by its
    largest coefficient (the first arm by name on ties).
    """
    big = rows.groupBy("arm").agg(F.count_distinct("image_id").alias("_n")).where(F.col("_n") >= min_images)
    arms = rows.join(big.select("arm"), "arm", "left_semi")
    kept = attach_one(arms.groupBy("image_id").agg(F.count_distinct("arm").alias("_k")), big.agg(F.count(F.lit(1)).alias("_all"))).where("_k = _all and _all > 1").select("image_id")
    common = staged(arms.join(kept, "image_id", "left_semi"), "common")
    units = staged(common.where(F.col("dimension") == "overall").select("image_id", bucket(F.col("gt")).alias("bucket")).distinct(), "units")
    fit = [n for n in sizes if n <= units.count()]
    if not fit:
        return rows.sparkSession.createDataFrame([], "n int, arm string, draws long, mean double, sd double, ci_width double, win_share double")
    picks = staged(subsamples(units, "bucket", "image_id", fit, repeats, seed), "picks")  # the sizes times ``repeats``, however many units
    per = staged(_plain_scores(common, picks, ["arm", "dimension"]), "scores")
    n = F.element_at(F.array(*[F.lit(n) for n in fit]), (F.floor(F.col("rep") / repeats) + 1).cast("int"))
    w = staged(weighted(per, ["arm"]).withColumn("n", n), "w")
    # nine digits keep the last bit of a sum from deciding a draw
    wins = w.groupBy("n", "rep").agg(F.min_by("arm", F.struct(-F.round("w", 9), "arm")).alias("arm")).groupBy("n", "arm").agg(F.count(F.lit(1)).alias("_wins"))
    stats = w.groupBy("n", "arm").agg(F.count("w").alias("draws"), F.avg("w").alias("mean"), F.stddev_pop("w").alias("sd"), (F.percentile("w", 0.975) - F.percentile("w", 0.025)).alias("ci_width"))
    return stats.join(wins, ["n", "arm"], "left").select("n", "arm", "draws", "mean", "sd", "ci_width", (F.coalesce("_wins", F.lit(0)) / repeats).alias("win_share"))
