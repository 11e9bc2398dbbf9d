"""Exact top-k by inner product, block at a time.

Candidates in ranges of ids make blocks: a forward index (the rows as a matrix) and the
largest and smallest value of every term. A query's bound of a block is the sum over terms
of its value times whichever of the two gives more. A query takes blocks in falling order
of bounds and scores them whole, until the next bound can't enter its best k.

Blocks come in groups, queries in slices, both of bounded size; a task holds one group and
one slice, and a query's bests of all groups are ranked at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256  # rows
GROUP = 64  # blocks
SLICE = 8192  # queries

PACK = "pack long, ids binary, width int, cells binary"


def _packs(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, cells) in order of ids as packs of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cells = [], []

        def pack(n: int) -> pa.RecordBatch:
            width = max(map(len, cells[:n]), default=0)
            matrix = np.zeros((n, width), np.int64)  # a shorter vector lacks its last terms
            for i, c in enumerate(cells[:n]):
                matrix[i, :len(c)] = c
            return pa.RecordBatch.from_arrays([pa.array([ids[0]], pa.int64()), pa.array([np.array(ids[:n], np.int64).tobytes()]), pa.array([width], pa.int32()), pa.array([matrix.tobytes()])], names=["pack", "ids", "width", "cells"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            cells += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield pack(size)
                del ids[:size], cells[:size]
        if ids:
            yield pack(len(ids))

    return rows.mapInArrow(run, PACK)


def _matrix(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    ids = [np.frombuffer(x.as_py(), np.int64) for x in table["ids"]]
    width = max(table["width"].to_pylist(), default=0)
    out = []
    for rows, w, cells in zip(ids, table["width"].to_pylist(), table["cells"], strict=True):
        m = np.zeros((len(rows), width))
        m[:, :w] = np.frombuffer(cells.as_py(), np.int64).reshape(len(rows), w)
        out.append(m)
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), out


def best(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids (-inf and -1 where there are fewer) of each query's k best, and blocks scored."""
    n = len(queries)
    top, who = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = np.stack([up @ m.max(axis=0) + down @ m.min(axis=0) for _, m in blocks], axis=1)
    order = np.argsort(-bound, axis=1, kind="stable")
    live, scored = np.arange(n), 0
    for nth in range(len(blocks)):
        mine = order[live, nth]
        open_ = bound[live, mine] >= top[live, -1]  # an equal score can still win by its id
        live, mine = live[open_], mine[open_]
        if not len(live):
            break
        for b in np.unique(mine):
            rows = live[mine == b]
            ids, matrix = blocks[b]
            scored += len(rows)
            score = queries[rows] @ matrix.T
            score[query_ids[rows][:, None] == ids[None, :]] = -np.inf
            some = score.max(axis=1) >= top[rows, -1]
            rows, score = rows[some], score[some]
            if not len(rows):
                continue
            score = np.concatenate((top[rows], score), axis=1)
            names = np.concatenate((who[rows], np.broadcast_to(ids, (len(rows), len(ids)))), axis=1)
            pick = np.lexsort((names, -score), axis=1)[:, :k]
            top[rows], who[rows] = np.take_along_axis(score, pick, 1), np.take_along_axis(names, pick, 1)
    who[np.isneginf(top)] = -1
    return top, who, scored


def search(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "cells") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates other than itself, ties to the smaller id.

    Vectors hold whole numbers; products must stay below 2^53 (refused otherwise), where sums of doubles are
    exact. Null ids, null vectors and vectors with a null take no part; a missing last term counts as 0.
    Candidates that share an id all count; queries that share one are one query, with the smallest
    vector. No queries or no candidates give no rows.
    """
    rows = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("cells")).where(F.col("id").isNotNull() & F.col("cells").isNotNull() & ~F.exists("cells", lambda x: x.isNull()))
    asked, given = rows(queries).groupBy("id").agg(F.min("cells").alias("cells")), rows(candidates)
    n_queries, n_given = asked.count(), given.count()
    groups, slices = max(1, math.ceil(n_given / (BLOCK * GROUP))), max(1, math.ceil(n_queries / SLICE))
    # ranges of ids; a pack is at most a block
    blocks = _packs(given.repartitionByRange(groups, "id").sortWithinPartitions("id"), BLOCK)
    blocks = blocks.withColumn("g", F.pmod(F.xxhash64("pack"), F.lit(groups)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    packs = _packs(asked.repartitionByRange(slices, "id").sortWithinPartitions("id"), BLOCK)
    packs = packs.withColumn("s", F.pmod(F.xxhash64("pack"), F.lit(slices)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(left) or not len(right):
            return kind.empty_table()
        query_ids, found = _matrix(left)
        asked_for = np.concatenate(found)
        names, matrices = _matrix(right)
        width = max(asked_for.shape[1], matrices[0].shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        edges = np.cumsum([0, *map(len, matrices)])
        index = [(names[a:b], wide(m)) for a, b, m in zip(edges[:-1], edges[1:], matrices, strict=True)]
        if np.abs(asked_for).max(initial=0) * max(np.abs(m).max(initial=0) for _, m in index) * max(width, 1) >= 2**53:
            raise ValueError("products of these vectors aren't exact")
        top, who, _ = best(query_ids, wide(asked_for), index, k)
        there = ~np.isneginf(top)
        return pa.table([np.repeat(query_ids, k)[there.ravel()], who[there], top[there].astype(np.int64)], schema=kind)

    # both sides have keys of one type: equal numbers of two types are dealt to different tasks
    parts = packs.groupBy("g", "s").cogroup(blocks.groupBy("g", "s")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(table: DataFrame, vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """floor(scale * x) of every component; a vector that is null or holds a null or non-finite component gets null."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.withColumn("cells", F.when(good, F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))))
