"""Detectors and neighbours over embedding tables.

Numpy works on Arrow batches inside tasks; Spark partitions, pairs and merges.
Only D x D matrices (D = embedding length) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.numerics import dbl, key_hash
from .ranking import attach_one
from .staging import staged

BLOCK = 4096


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


# ---- moments -----------------------------------------------------------------------

FAN_IN = 16  # partial results that are merged at once


def _merged(partials: DataFrame, merge) -> np.ndarray | None:
    """One array from a packed array per task (``part``, ``data``), merged ``FAN_IN`` at a time.

    The last ``FAN_IN`` are merged on the driver; None without any.
    """
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for data in pdf.sort_values("part")["data"]:
            x = np.frombuffer(data)
            whole = x if whole is None else merge(whole, x)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN_IN], "data": [whole.tobytes()]})

    level = staged(partials, "partials")
    while level.count() > FAN_IN:
        level = staged(level.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(join, "part long, data binary"), "partials")
    rows = level.orderBy("part").collect()
    whole = None
    for r in rows:
        x = np.frombuffer(bytes(r.data))
        whole = x if whole is None else merge(whole, x)
    return whole


def _per_task(df: DataFrame, vector: str, work) -> DataFrame:
    """``work(whole so far or None, rows)`` over the batches of every task, one packed array each."""
    def run(batches):
        whole = None
        for pdf in batches:
            pdf = pdf[pdf[vector].notna()]
            if len(pdf):
                whole = work(whole, _stack(pdf[vector]))
        if whole is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "data": [whole.tobytes()]})

    return df.select(vector).mapInPandas(run, "part long, data binary")


def gram(df: DataFrame, vector: str, centre: np.ndarray | None = None) -> tuple[int, np.ndarray, float]:
    """Row count, sum of outer products and sum of fourth powers of norms, around ``centre``.

    Every task adds up its own batches and passes on one packed array.
    """
    def add(whole, x):
        if centre is not None:
            x = x - centre
        now = np.concatenate([[len(x), float(np.sum(np.sum(x * x, axis=1) ** 2))], (x.T @ x).ravel()])
        return now if whole is None else whole + now

    table = _merged(_per_task(df, vector, add), np.add)
    if table is None:
        raise ValueError("no vectors")
    d = int(round((len(table) - 2) ** 0.5))
    return int(round(table[0])), table[2:].reshape(d, d), float(table[1])


def _spread(whole, more):
    """Two (count, means, squared deviations) as one."""
    if whole is None:
        return more
    n, m = whole[0], more[0]
    d = (len(whole) - 1) // 2
    gap = more[1:1 + d] - whole[1:1 + d]
    mean = whole[1:1 + d] + gap * (m / (n + m))
    return np.concatenate([[n + m], mean, whole[1 + d:] + more[1 + d:] + gap * gap * (n * m / (n + m))])


def _moments(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    def add(whole, x):
        mean = x.mean(axis=0)
        return _spread(whole, np.concatenate([[len(x)], mean, np.sum((x - mean) ** 2, axis=0)]))

    table = _merged(_per_task(df, vector, add), _spread)
    if table is None:
        return np.zeros(0), np.zeros(0)
    d = (len(table) - 1) // 2
    return table[1:1 + d], table[1 + d:] / table[0]


def mean_vector(df: DataFrame, vector: str) -> np.ndarray:
    return _moments(df, vector)[0]


def moments(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population variance per coordinate, as a table (D rows)."""
    mean, variance = _moments(df, vector)
    return df.sparkSession.createDataFrame([(i, float(m), float(v)) for i, (m, v) in enumerate(zip(mean, variance))], "i int, mean double, variance double")


@dataclass(frozen=True)
class Detector:
    mean: np.ndarray
    precision: np.ndarray
    shrinkage: float
    n: int


def fit_detector(ref: DataFrame, vector: str = "embedding") -> Detector:
    """Mean and inverse of the Ledoit-Wolf shrunk covariance."""
    centre = mean_vector(ref, vector)
    n, outer, fourth = gram(ref, vector, centre)
    s, p = outer / n, len(centre)
    mu, norm = np.trace(s) / p, float(np.sum(s * s))
    beta, delta = (fourth / n - norm) / (p * n), (norm - p * mu * mu) / p
    shrink = 0.0 if delta == 0 else min(beta, delta) / delta
    shrunk = (1 - shrink) * s
    shrunk[np.diag_indices(p)] += shrink * mu
    return Detector(centre, np.linalg.inv(shrunk), float(shrink), n)


def mahalanobis(df: DataFrame, detector: Detector, vector: str = "embedding", out: str = "distance") -> DataFrame:
    """Distance of every row to the reference; the D x D parameters travel once per executor."""
    shared = df.sparkSession.sparkContext.broadcast((detector.mean, detector.precision))

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        mean, precision = shared.value
        gap = _stack(v) - mean
        return pd.Series(np.sqrt(np.maximum(np.sum((gap @ precision) * gap, axis=1), 0.0)))

    return df.withColumn(out, distance(F.col(vector)))


def diagonal_distance(df: DataFrame, params: DataFrame, vector: str = "embedding", out: str = "distance") -> DataFrame:
    """Distance under a diagonal covariance: plain array expressions, no Python."""
    one = params.agg(F.array_sort(F.collect_list(F.struct("i", "mean", "variance"))).alias("_p"))  # D entries
    terms = F.zip_with(F.col(vector), F.col("_p"), lambda v, p: (v.cast("double") - p["mean"]) * (v.cast("double") - p["mean"]) / p["variance"])
    return attach_one(df, one).withColumn(out, F.sqrt(F.aggregate(terms, dbl(0), lambda a, x: a + x))).drop("_p")


# ---- neighbours -------------------------------------------------------------------------

NEIGHBOUR = "array<struct<d: double, id: bigint>>"


def _block_scores(k: int):
    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["q", "top", "cos_max", "cos_sum"]
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"q": [], "top": [], "cos_max": [], "cos_sum": []})
        a, b = _stack(left["v"]), _stack(right["v"])
        ids = right["id"].to_numpy()
        m = min(k, len(b))
        out = []
        unit_b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        sq_b = np.sum(b * b, axis=1)
        for start in range(0, len(a), 512):
            x = a[start:start + 512]
            approx = np.sum(x * x, axis=1)[:, None] + sq_b - 2 * (x @ b.T)
            near = np.argpartition(approx, m - 1, axis=1)[:, :m]
            exact = np.sqrt(np.sum((b[near] - x[:, None, :]) ** 2, axis=2))
            cos = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ unit_b.T
            peak = cos.max(axis=1)
            mass = np.sum(np.exp(cos - peak[:, None]), axis=1)
            for i in range(len(x)):
                out.append((int(left["id"].iloc[start + i]), [{"d": float(d), "id": int(j)} for d, j in zip(exact[i], ids[near[i]])],
                            float(peak[i]), float(mass[i])))
        return pd.DataFrame(out, columns=cols)

    return score


def neighbour_scores(queries: DataFrame, ref: DataFrame, key: str, vector: str = "embedding", k: int = 10, block: int = BLOCK) -> DataFrame:
    """Exact k nearest reference rows, highest cosine and log-sum-exp of cosines per query.

    Both sides are cut by key hash into blocks of about ``block`` rows; a task
    meets one query block and one reference block and returns only k candidates
    and two partial sums per query, which are merged in two rounds. Neither side
    is ever whole in one task.
    """
    def blocks(df):
        return attach_one(df, df.agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb")))

    q = blocks(queries.select(F.col(key).alias("id"), F.col(vector).alias("v"))).withColumn("qb", (key_hash("q", F.col("id")) % F.col("_nb")).cast("int"))
    r = blocks(ref.select(F.col(key).alias("id"), F.col(vector).alias("v"))).withColumn("rb", (key_hash("r", F.col("id")) % F.col("_nb")).cast("int"))
    q_counts, r_counts = q.agg(F.max("_nb").alias("_nq")), r.agg(F.max("_nb").alias("_nr"))
    q_out = attach_one(q.drop("_nb"), r_counts).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))).drop("_nr")
    r_out = attach_one(r.drop("_nb"), q_counts).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))).drop("_nq")
    pairs = q_out.groupBy("qb", "rb").cogroup(r_out.groupBy("qb", "rb")).applyInPandas(
        _block_scores(k), f"q bigint, top {NEIGHBOUR}, cos_max double, cos_sum double").withColumn("_g", F.spark_partition_id() % 64)

    def merge(df, by):
        best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        peaks = df.groupBy(*by).agg(best.alias("top"), F.max("cos_max").alias("_m"), F.collect_list(F.struct("cos_max", "cos_sum")).alias("_c"))
        total = F.aggregate("_c", dbl(0), lambda acc, c: acc + c["cos_sum"] * F.exp(c["cos_max"] - F.col("_m")))
        return peaks.select(*by, "top", F.col("_m").alias("cos_max"), total.alias("cos_sum"))

    merged = merge(merge(pairs, ["q", "_g"]), ["q"])
    return merged.select(F.col("q").alias(key), "top", "cos_max", (F.col("cos_max") + F.log("cos_sum")).alias("log_sum_exp"))


# ---- nearest rows with pruning --------------------------------------------------------------

PIVOTS, PER_CELL = 512, 256  # most pivots; reference rows for each of them
QUERY_GROUPS, REF_GROUPS = 16, 4  # of large tables, if groups stay below these numbers of values
QUERY_VALUES, REF_VALUES = 1 << 21, 1 << 23
AT_ONCE = 1 << 21  # distances worked on at once


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.sum(x * x, axis=1)[:, None] + np.sum(y * y, axis=1) - 2 * (x @ y.T), 0.0))


def _slack(*squares: float) -> float:
    """What rounding may add to or take from a distance that was worked out from squares up to these."""
    return 1e-7 * (1 + max(squares)) ** 0.5


def _closest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row of ``x``, exact distance and id of each row's k nearest of the allowed rows within its bound,
    smaller ids first on ties.

    A fast product finds all that lie within rounding of the k-th; only those are measured."""
    sx, sy = np.sum(x * x, axis=1), np.sum(y * y, axis=1)
    rough = sx[:, None] + sy - 2 * (x @ y.T)
    rough[~allowed] = np.inf
    m = min(k, len(y))
    last = np.minimum(np.partition(rough, m - 1, axis=1)[:, m - 1], bound * bound)
    q, r = np.nonzero((rough <= (last + 1e-9 * (1 + sx + sy.max()))[:, None]) & allowed)
    step = max(1, AT_ONCE // x.shape[1])
    exact = np.concatenate([np.zeros(0), *(np.sqrt(np.sum((y[r[i:i + step]] - x[q[i:i + step]]) ** 2, axis=1)) for i in range(0, len(q), step))])
    order = np.lexsort((ids[r], exact, q))
    q = q[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], exact[order][first], ids[r[order]][first]


def _few_copies(y: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of all rows but those that k rows of the same vector and smaller ids come before."""
    _, same = np.unique(np.ascontiguousarray(y).view(f"V{y.shape[1] * y.itemsize}").ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    ranked = same[order]
    return np.sort(order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k])


def _chain(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order where each is followed by the closest one that is left."""
    d = _distances(pivots, pivots)
    order, left = [0], np.ones(len(d), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, d[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return np.array(order)


def _grouped(counts: np.ndarray, order: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of every cell: cells that follow one another share a group of at most ``size`` rows, larger cells are cut."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    group, held = 0, 0
    for c in order:
        if held and held + counts[c] > size:
            group, held = group + 1, 0
        first[c], parts[c] = group, max(1, -(-int(counts[c]) // size))
        held += int(counts[c])
        if parts[c] > 1:
            group, held = group + int(parts[c]), 0
    return first, parts


def nearest(queries: DataFrame, ref: DataFrame, key: str, vector: str = "embedding", k: int = 10, block: int = BLOCK) -> DataFrame:
    """key, ``top`` (the k nearest reference rows by distance, then id) and ``visited`` (rows compared).

    Reference rows belong to the cell of their nearest pivot (rows of the reference itself, by key
    hash). A query first meets its closest cells, as many as hold k rows, which bounds its
    k-th distance; of the others only cells that the triangle inequality leaves within that bound.
    Neighbouring cells share groups of bounded size, and crowded cells are cut into several; a task meets
    one group of queries and one of reference rows, so vectors are sent once per group and not per cell.
    """
    spark = ref.sparkSession
    rows = ref.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    wanted = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    n = rows.count()
    if not n:
        return wanted.select("id").withColumns({"top": F.array().cast(NEIGHBOUR), "visited": F.lit(0).cast("long")}).withColumnRenamed("id", key)
    chosen = rows.orderBy(key_hash("pivot", F.col("id")), "id").limit(max(1, min(PIVOTS, n // PER_CELL))).toPandas()  # PIVOTS rows at most
    places = _stack(chosen["v"])
    every = spark.sparkContext.broadcast(places)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(_stack(pdf["v"]), every.value)
                home = d.argmin(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cell": home, "reach": d[np.arange(len(d)), home]})

    kind = rows.schema["v"].dataType.simpleString()
    cells = staged(rows.mapInPandas(assign, f"id long, v {kind}, cell int, reach double"), "cells")
    facts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high"),
                                      F.max(F.aggregate("v", dbl(0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("square")).orderBy("cell").toPandas()  # a row per pivot
    name, held = facts["cell"].to_numpy(), facts["n"].to_numpy()
    pivots, order = places[name], _chain(places[name])
    first_ref, parts_ref = _grouped(held, order, max(block, min(n // REF_GROUPS, REF_VALUES // places.shape[1])))
    shared = spark.sparkContext.broadcast((pivots, held, facts["low"].to_numpy(), facts["high"].to_numpy(), float(facts["square"].max())))

    def locate(batches):
        for pdf in batches:
            if len(pdf):
                pivots, held, *_ = shared.value
                d = _distances(_stack(pdf["v"]), pivots)
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                many = np.sum(before < k, axis=1)  # the closest cells that together hold k rows
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cell": order[:, 0], "home": [o[:m] for o, m in zip(order, many)]})

    asked = staged(wanted.mapInPandas(locate, f"id long, v {kind}, cell int, home array<int>"), "queries")
    asks = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row per pivot
    asks = np.array([asks.get(c, 0) for c in range(len(name))])
    first_query, parts_query = _grouped(asks, order, max(block, min(int(asks.sum()) // QUERY_GROUPS, QUERY_VALUES // places.shape[1])))

    def table(firsts, parts):
        return spark.createDataFrame([(c, int(a), int(b)) for c, (a, b) in enumerate(zip(firsts, parts))], "cell int, f long, m long")

    def dealt(df, firsts, parts, out):
        at = F.col("f") + F.pmod(F.xxhash64(F.lit(out), "id"), F.col("m"))
        return df.join(table(firsts, parts), "cell").withColumn(out, at.cast("int")).drop("f", "m")

    names = spark.createDataFrame([(int(c), i) for i, c in enumerate(name)], "cell int, at int")
    parts = staged(dealt(cells.join(names, "cell").select(F.col("at").alias("cell"), "id", "v"), first_ref, parts_ref, "rg"), "parts")
    asked = dealt(asked, first_query, parts_query, "qg")

    def open_cells(x: np.ndarray, home, bound: np.ndarray | None) -> np.ndarray:
        """Cells a query goes to: its closest ones, or without them all that its bound leaves."""
        pivots, _, low, high, square = shared.value
        own = np.zeros((len(x), len(pivots)), bool)
        own[np.repeat(np.arange(len(x)), [len(h) for h in home]), np.concatenate(list(home))] = True
        if bound is None:
            return own
        d = _distances(x, pivots)
        reach = bound[:, None] + _slack(square, float(np.sum(x * x, axis=1).max()))
        return ~own & (np.maximum(d - high, low - d) <= reach)

    def route(bounded: bool, whole: bool):
        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                open_ = open_cells(_stack(pdf["v"]), pdf["home"], pdf["bound"].to_numpy(float) if bounded else None)
                for g in range(int((first_ref + parts_ref).max())):
                    goes = open_[:, (first_ref <= g) & (g < first_ref + parts_ref)].any(axis=1)
                    if goes.any():
                        some = pdf[goes]
                        yield some.assign(rg=g) if whole else pd.DataFrame({"qg": some["qg"].unique(), "rg": g})
        return run

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            y, ids, cell = _stack(right["v"]), right["id"].to_numpy(), right["cell"].to_numpy()
            few = _few_copies(y, ids, k)
            y, ids, cell = y[few], ids[few], cell[few]
            step = max(1, AT_ONCE // len(y))
            for _, near in left.groupby("cell"):
                for start in range(0, len(near), step):
                    some = near.iloc[start:start + step]
                    x, who = _stack(some["v"]), some["id"].to_numpy()
                    bound = some["bound"].to_numpy(float)
                    first = np.isnan(bound)
                    open_ = open_cells(x, some["home"], None if first.all() else bound)
                    met = np.flatnonzero(open_.any(axis=0)[cell])
                    if not len(met):
                        continue
                    allowed = open_[:, cell[met]]
                    square = float(max(np.sum(x * x, axis=1).max(), np.sum(y[met] * y[met], axis=1).max()))
                    q, d, i = _closest(x, y[met], ids[met], k, allowed, np.where(first, np.inf, bound + _slack(square)))
                    edges = np.searchsorted(q, np.arange(len(x) + 1))
                    seen = allowed.sum(axis=1)
                    out.extend((who[j], d[a:b], i[a:b], seen[j]) for j, (a, b) in enumerate(zip(edges, edges[1:])) if seen[j])
        return pd.DataFrame(out, columns=["q", "d", "id", "visited"])

    def visit(some: DataFrame, bounded: bool) -> DataFrame:
        pairs = staged(some.mapInPandas(route(bounded, False), "qg int, rg int").distinct(), "pairs")
        sent = some if bounded else some.withColumn("bound", F.lit(None).cast("double"))
        sent = sent.select("id", "v", "cell", "home", "qg", "bound")
        spread = sent.mapInPandas(route(bounded, True), f"id long, v {kind}, cell int, home array<int>, qg int, bound double, rg int")
        copies = parts.join(pairs, "rg").select("id", "v", "cell", "qg", "rg")
        return spread.groupBy("qg", "rg").cogroup(copies.groupBy("qg", "rg")).applyInPandas(score, "q long, d array<double>, id array<bigint>, visited long")

    def merge(found: DataFrame) -> DataFrame:
        best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        return found.groupBy("q").agg(best.alias("top"), F.sum("visited").alias("visited"))  # k entries per group that was visited

    zipped = lambda found: found.repartition("q").select("q", F.arrays_zip("d", "id").cast(NEIGHBOUR).alias("top"), "visited")
    home = staged(merge(zipped(visit(asked, False))), "home")
    bounded = asked.join(home.select(F.col("q").alias("id"), F.when(F.size("top") < k, dbl("inf")).otherwise(F.col("top")[k - 1]["d"]).alias("bound")), "id")
    rest = zipped(visit(bounded, True))
    return merge(home.unionByName(rest)).withColumnRenamed("q", key)


def nearest_cosine(queries: DataFrame, ref: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, ``cos_max``: the highest cosine, found as the nearest row on the unit sphere; zero vectors have cosine 0 with all."""
    square = F.aggregate(vector, dbl(0), lambda a, x: a + x.cast("double") * x.cast("double"))
    unit = lambda df: df.withColumn("_s", square).where("_s > 0").select(key, F.transform(vector, lambda x: x.cast("double") / F.sqrt("_s")).alias("u"))
    near = nearest(unit(queries), unit(ref), key, "u", 1).where(F.size("top") > 0)
    found = near.select(key, (dbl(1) - F.col("top")[0]["d"] * F.col("top")[0]["d"] / 2).alias("cos_max"))
    return queries.select(key).join(found, key, "left").select(key, F.coalesce("cos_max", dbl(0)).alias("cos_max"))


def knn_distance(scores, k: int):
    """Mean distance to the k nearest (fewer if the reference is smaller)."""
    near = F.slice(F.col(scores), 1, k)
    return F.aggregate(near, dbl(0), lambda acc, x: acc + x["d"]) / F.size(near)


# ---- ridge probe ------------------------------------------------------------------------------

def ridge_probe(train: DataFrame, test: DataFrame, vector: str, targets: Sequence[str], key: str,
                alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)) -> DataFrame:
    """Predictions of the test rows for every penalty and target, long.

    The training data is read twice (moments, then the standardised Gram matrix
    with the targets appended); all penalties are solved from that one matrix.
    """
    stats = moments(train, vector).toPandas().sort_values("i")  # D rows
    centre, scale = stats["mean"].to_numpy(), np.sqrt(stats["variance"].to_numpy())
    scale = np.where(scale == 0, 1.0, scale)
    d, names = len(centre), list(targets)
    joined = train.select(F.concat(F.transform(vector, lambda v: v.cast("double")), F.array(*[F.col(n).cast("double") for n in names])).alias("z"))
    offsets = train.agg(*[F.avg(n).alias(n) for n in names]).first()
    shift = np.concatenate([centre, [offsets[n] for n in names]])
    _, g, _ = gram(joined, "z", shift)
    xx, xy = g[:d, :d] / np.outer(scale, scale), g[:d, d:] / scale[:, None]
    weights = {(a, n): np.linalg.solve(xx + a * np.eye(d), xy[:, i]) for a in alphas for i, n in enumerate(names)}
    shared = test.sparkSession.sparkContext.broadcast((centre, scale, weights, {n: offsets[n] for n in names}))
    order = [(a, n) for a in alphas for n in names]

    def predict(batches):
        mean, sd, w, base = shared.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = (_stack(pdf["v"]) - mean) / sd
            for a, n in order:
                yield pd.DataFrame({key: pdf["id"], "alpha": a, "target": n, "prediction": x @ w[(a, n)] + base[n], "truth": pdf[n]})

    rows = test.select(F.col(key).alias("id"), F.col(vector).alias("v"), *[F.col(n).cast("double").alias(n) for n in names])
    return rows.mapInPandas(predict, f"`{key}` bigint, alpha double, target string, prediction double, truth double")
