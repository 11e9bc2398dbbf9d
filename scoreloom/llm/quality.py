"""Quality classifier: naive Bayes support vectors over n-grams.

N-grams are those of bytes and those of *echoes*: a word counts as 1 if it equals the
word before, 2 if the one before that, else 0. An n-gram counts once per text. Class counts over *all* labelled training texts give
log-count ratios; indicators scaled by them, at unit length, feed a linear hinge-loss
model fitted by dual coordinate descent on a sample of at most ``sample_rows`` texts.
N-grams are hashed to 2^BITS buckets, which bounds counts, weights and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textblocks import SPACE_WORDS, Words, byte_values, chunks

BITS = 17
ORDERS = (2, 3)
ECHO_ORDER = 4
SEND_MOST = 1_000_000  # labels that may be broadcast; beyond, a shuffled join
_U = np.uint64


@dataclass
class Model:
    """Weights per bucket: ``ratio`` scales an indicator, ``slope`` is ratio times weight."""

    ratio: np.ndarray
    slope: np.ndarray
    bias: float
    converged: bool


class Indicators:
    """Distinct n-gram buckets of texts."""

    def __init__(self):
        self.stamp = np.zeros(1 << BITS, np.int32)

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        words = Words(texts, SPACE_WORDS)
        block = words.bytes
        data = block.data.astype(np.uint64) + _U(1)
        grams, value = {}, data
        for k in range(2, max(ORDERS) + 1):
            value = value[:-1] * _U(257) + data[k - 1:]
            if k in ORDERS:
                grams[k] = (((value + _U(k << 40)) * _U(0x9E3779B97F4A7C15)) >> _U(64 - BITS)).astype(np.int32)
        h, doc = words.hash, words.doc
        echo = np.zeros(len(h) + ECHO_ORDER, np.uint64)
        echo[2:len(h)][(h[2:] == h[:-2]) & (doc[2:] == doc[:-2])] = 2
        echo[1:len(h)][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] = 1
        value = echo[:len(h)]
        for k in range(1, ECHO_ORDER):
            value = value * _U(3) + echo[k:len(h) + k]
        echoes = (((value + _U(1 << 60)) * _U(0x9E3779B97F4A7C15)) >> _U(64 - BITS)).astype(np.int32)
        for a, b, c, d in zip(block.begin.tolist(), block.end.tolist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            keys = np.concatenate([*(grams[k][a:max(a, b - k + 1)] for k in ORDERS), echoes[c:max(c, d - ECHO_ORDER + 1)]])
            at = np.arange(len(keys), dtype=np.int32)
            self.stamp[keys] = at
            yield keys[self.stamp[keys] == at]


def class_counts(rows: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """bucket, good, bad: labelled texts of each class that hold an n-gram of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = Indicators(), np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            texts, labels = byte_values(batch.column(0)), batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                for keys, label in zip(seen.of(texts[lo:hi]), labels[lo:hi], strict=True):
                    counts[label][keys] += 1
        found = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[1][found]), pa.array(counts[0][found])], names=["bucket", "good", "bad"])

    part = rows.select(F.col(text_col), F.col(label_col).cast("int")).mapInArrow(run, "bucket long, good long, bad long")
    return part.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, tolerance: float) -> Model:
    """Dual coordinate descent for the hinge loss: each step solves one text's multiplier exactly."""
    values = [ratio[k] for k in rows]
    values = [v / (np.sqrt(v @ v) or 1.0) for v in values]
    signs = np.where(labels == 1, 1.0, -1.0)
    square = np.array([v @ v + 1.0 for v in values])  # one more feature, always 1, carries the bias
    weights, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    converged = False
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            g = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            step = min(max(alpha[i] - g / square[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                weights[rows[i]] += step * signs[i] * values[i]
                bias += step * signs[i]
                worst = max(worst, abs(step) * square[i])
        if worst < tolerance:
            converged = True
            break
    return Model(ratio, ratio * weights, bias, converged)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_rows: int = 8000, smoothing: float = 1.0, cost: float = 1.0, rounds: int = 60, tolerance: float = 0.01) -> Model:
    """Fit on the texts that ``labels`` marks 0 or 1 (other and null labels, and ids without a
    text row, play no part). Counts use all of them; the descent a sample of at most
    ``sample_rows``, half of each class where there are enough, chosen by the hash of the id.

    Without labelled texts of both classes every ratio is 0 and the bias decides.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    few = marked.count() <= SEND_MOST  # then texts needn't be shuffled
    counts = class_counts(texts.join(F.broadcast(marked) if few else marked, "_id"), "_text", "_label").collect()  # 2^BITS rows at most
    good, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in counts:
        good[r.bucket], bad[r.bucket] = r.good, r.bad
    p, q = good + smoothing, bad + smoothing
    ratio = np.where(good + bad > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)

    ranked = [marked.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows // 2) for c in (0, 1)]
    chosen = ranked[0].unionAll(ranked[1])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Indicators()
        for batch in batches:
            found = byte_values(batch.column(0))
            for lo, hi in chunks(found):
                yield pa.RecordBatch.from_arrays([batch.column(1)[lo:hi], pa.array([k for k in seen.of(found[lo:hi])], pa.list_(pa.int32())), batch.column(2)[lo:hi]], names=["_label", "keys", "_id"])

    kind = T.StructType([T.StructField("_label", T.IntegerType()), T.StructField("keys", T.ArrayType(T.IntegerType())), T.StructField("_id", docs.schema[id_col].dataType)])
    # sample_rows ids bound the broadcast
    sample = texts.join(F.broadcast(chosen), "_id").select("_text", "_label", "_id").mapInArrow(gather, kind)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, marks, ids = [], [], []
        for batch in batches:
            flat, edge = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            edge = edge - edge[0]
            keys += [flat[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            marks += batch.column(0).to_pylist()
            ids += batch.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], marks[i], len(keys[i])))  # one order, however rows arrive
        model = descend([keys[i] for i in order], np.array([marks[i] for i in order], int), ratio, cost, rounds, tolerance)
        yield pa.RecordBatch.from_arrays([pa.array([model.slope.astype("<f8").tobytes()]), pa.array([model.bias]), pa.array([model.converged])], names=["slope", "bias", "converged"])

    rows = sample.repartition(1).mapInArrow(solve, "slope binary, bias double, converged boolean").collect()
    if not rows:
        return Model(ratio, np.zeros(1 << BITS), 0.0, True)
    return Model(ratio, np.frombuffer(rows[0].slope, "<f8"), rows[0].bias, rows[0].converged)


def score(docs: DataFrame, model: Model, out_col: str = "score", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the probability-like score of class 1 (an existing
    ``out_col`` is replaced).

    Texts without n-grams, empty and null ones included, get the bias alone. Repeated rows
    each get their score; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c.lower() != out_col.lower()]
    at = docs.columns.index(text_col)
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.slope, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, slope, bias = shared.value
        both = np.stack((slope, ratio * ratio), axis=1).astype(np.float64)
        seen = Indicators()
        for batch in batches:
            texts, out = byte_values(batch.column(at)), []
            for lo, hi in chunks(texts):
                for keys in seen.of(texts[lo:hi]):
                    total, square = both[keys].sum(axis=0)
                    out.append(total / np.sqrt(square) + bias if square > 0 else bias)
            margins = 1.0 / (1.0 + np.exp(-2.0 * np.array(out, float)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(margins)], names=[*batch.schema.names, out_col])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(out_col, T.DoubleType())]))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows that the model scores 0.5 or more, with their own columns."""
    from .stages import spare

    name = spare(docs, "quality_score")
    return score(docs, model, name).where(F.col(name) >= 0.5).drop(name)
