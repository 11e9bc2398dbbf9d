"""Exact ranked lexical search over impact vectors in buckets of similar length.

A text's impact vector holds, for each of its terms that any item has, the saturated count; an
item's vector holds the terms' weights; the score is their product. Texts are ordered by the
length of their vectors and dealt into buckets. Items take a bucket only if the item's length
times that of the longest text reaches the item's k-th best score (Cauchy-Schwarz). Inside, the
item's heaviest coordinates are multiplied out, and the rest is bounded by the product of what
is left of both lengths, coordinate by coordinate; texts whose bound falls short go. Survivors
are scored again in whole numbers. The longest buckets are searched first, and every other
task starts from the k-th scores found there.

Items are taken in groups of at most about ``PAIRS`` terms, each group in a pass of its own over
all texts: its vocabulary and vectors are what is sent to tasks, and texts are cut to that
vocabulary when they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import written
from .textblocks import ALNUM_WORDS, Words, byte_values, chunks

PAIRS = 1_000_000  # (item, term) pairs of a group, 32 bytes each
BUCKET = 1024  # texts
STEP = 4  # coordinates of an item between two bounds
LONGEST = 0.98  # the share of lengths below those that are searched first


def counts(texts: list[bytes], vocabulary: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Terms in each text, and places in the sorted vocabulary with their occurrences."""
    for lo, hi in chunks(texts):
        words = Words(texts[lo:hi], ALNUM_WORDS, lower=True)
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
            known = vocabulary[at] == words.hash
            cell, times = np.unique(words.doc[known] * len(vocabulary) + at[known], return_counts=True)
            doc, term = np.divmod(cell, len(vocabulary))
        else:
            doc = term = times = np.zeros(0, np.int64)
        edge = np.searchsorted(doc, np.arange(hi - lo + 1))
        for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            yield int(words.counts[i]), term[a:b].astype(np.int32), times[a:b].astype(np.int32)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, t: the distinct terms (hashes) of every item; rows that share an id are one item."""
    kind = items.select(F.col(id_col).alias("item_id"), F.lit(0).cast("long").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch.column(1))
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi], ALNUM_WORDS, lower=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(words.doc + lo)), pa.array(words.hash.view(np.int64))], names=["item_id", "t"])

    return items.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(run, kind.schema).distinct()


def _vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """id, n, terms, times (int32 in binary) of every text; terms are places in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a group's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, t.tobytes(), c.tobytes()) for n, t, c in counts(byte_values(batch.column(1)), sent.value)]
            n, t, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(t, pa.binary()), pa.array(c, pa.binary())], names=["id", "n", "terms", "times"])

    return docs.mapInArrow(run, "id long, n long, terms binary, times binary")


def _document_counts(vectors: DataFrame) -> DataFrame:
    """place, df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            place, df = np.unique(held, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(df, pa.int64())], names=["place", "df"])

    return vectors.select("terms").mapInArrow(run, "place int, df long").groupBy("place").agg(F.sum("df").alias("df"))


def _impacts(vectors: DataFrame, n_texts: int, n_all: int) -> DataFrame:
    """id, length, terms, impacts of the texts that share a term with an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) // 4 for x in batch.column(3).to_pylist()], np.int64)
            tf = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32).astype(np.int64)
            m = 10 + 90 * batch.column(1).to_numpy() * n_texts // n_all
            impact = (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size))).astype(np.int32)
            edge = np.concatenate(([0], np.cumsum(size)))
            squares = np.concatenate(([0.0], np.cumsum(impact.astype(np.float64) ** 2)))
            length = np.sqrt(np.array([float((impact[a:b].astype(np.float64) ** 2).sum()) for a, b in zip(edge[:-1], edge[1:], strict=True)])) if len(size) else squares[:0]
            cells = [impact[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), batch.column(2), pa.array(cells, pa.binary())], names=["id", "length", "terms", "impacts"])

    return vectors.where("length(terms) > 0 and id is not null").select("id", "n", "terms", "times").mapInArrow(run, "id long, length double, terms binary, impacts binary")


class Items:
    """Vectors of a group of items, each with its heaviest coordinates first."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, weights: np.ndarray):
        order = np.lexsort((places, -weights, ids))
        ids, self.places, self.weights = ids[order], places[order], weights[order]
        self.ids, first = np.unique(ids, return_index=True)
        self.edges = np.append(first, len(ids))
        self.parts = [slice(a, b) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        # length of what follows each coordinate of an item, itself included
        self.rest = [np.append(np.sqrt(np.cumsum((self.weights[p].astype(np.float64) ** 2)[::-1]))[::-1], 0.0) for p in self.parts]


class Bucket:
    """Texts of similar length by term: ``rows(t)`` and ``values(t)``."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: list[bytes], impacts: list[bytes]):
        self.ids, self.lengths = ids, lengths
        size = [len(t) // 4 for t in terms]
        row, term, value = np.repeat(np.arange(len(ids)), size), np.frombuffer(b"".join(terms), np.int32), np.frombuffer(b"".join(impacts), np.int32)
        order = np.argsort(term, kind="stable")
        self.rows, self.values = row[order], value[order].astype(np.int64)
        self.names, first = np.unique(term[order], return_index=True)
        self.edges = np.append(first, len(term))

    def column(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.names, place)
        if i == len(self.names) or self.names[i] != place:
            return self.rows[:0], self.values[:0]
        return self.rows[self.edges[i]:self.edges[i + 1]], self.values[self.edges[i]:self.edges[i + 1]]


class Best:
    """The k best (score, id) of every item so far; ``least`` starts from known k-th scores."""

    def __init__(self, items: Items, k: int, least: np.ndarray | None = None):
        self.items, self.k, self.scored = items, k, 0
        self.least = np.ones(len(items.ids), np.int64) if least is None else np.maximum(least, 1)
        self.scores, self.who = [np.zeros(0, np.int64)] * len(items.ids), [np.zeros(0, np.int64)] * len(items.ids)

    def take(self, bucket: Bucket) -> None:
        longest = bucket.lengths.max(initial=0.0) * (1 + 1e-9)
        for i, part in enumerate(self.items.parts):
            rest, least = self.items.rest[i], self.least[i]
            if rest[0] * longest < least:
                continue
            score, left = np.zeros(len(bucket.ids), np.int64), bucket.lengths**2
            live = rest[0] * bucket.lengths * (1 + 1e-9) >= least
            places, weights = self.items.places[part], self.items.weights[part]
            for j, (place, weight) in enumerate(zip(places.tolist(), weights.tolist(), strict=True)):
                if j and not j % STEP:
                    live &= score + rest[j] * np.sqrt(np.maximum(left, 0.0) + 1.0) * (1 + 1e-9) >= least
                    if not live.any():
                        break
                rows, values = bucket.column(place)
                score[rows] += weight * values
                left[rows] -= values.astype(np.float64) ** 2
            good = np.flatnonzero(live & (score >= least))
            self.scored += int(live.sum())
            if len(good):
                scores, who = np.concatenate((self.scores[i], score[good])), np.concatenate((self.who[i], bucket.ids[good]))
                pick = np.lexsort((who, -scores))[: self.k]
                self.scores[i], self.who[i] = scores[pick], who[pick]
                if len(pick) == self.k:
                    self.least[i] = max(least, scores[pick[-1]])

    def table(self) -> pa.RecordBatch:
        size = [len(s) for s in self.scores]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(size)), size), pa.int64()), pa.array(np.concatenate(self.who)), pa.array(np.concatenate(self.scores))], names=["item", "doc_id", "score"])


def _search(buckets: DataFrame, items: Items, k: int, least: np.ndarray | None) -> DataFrame:
    sent = buckets.sparkSession.sparkContext.broadcast((items, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, known = sent.value
        best = Best(mine, k, known)
        for batch in batches:
            for lo in range(0, len(batch), BUCKET):
                b = batch.slice(lo, BUCKET)
                best.take(Bucket(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_pylist()))
        if len(mine.ids):
            yield best.table()

    found = buckets.select("id", "length", "terms", "impacts").mapInArrow(run, "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best texts with a score above 0, ties to the smaller id.

    Ids are whole numbers; ids of items keep their type. A null text has no terms. Texts with a null id count in the statistics and
    are never returned; items with a null id take no part; items that share an id are one item, texts that share
    one are texts of their own. A very long text enters whole. Extra columns play no part. No items, no texts or
    no common terms give no rows.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = written(item_terms(items, item_id, text_col), "item-terms")
    groups = max(1, -(-asked.count() // PAIRS))
    found = [_search_group(texts, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group), k) for group in range(groups)]
    return reduce(DataFrame.unionAll, found)


def _search_group(texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The search for one group of items (item_id, t)."""
    pairs = asked.toPandas()  # about PAIRS rows
    vocabulary, places = np.unique(pairs["t"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    vectors = written(_vectors(texts, vocabulary), "vectors")
    n_texts, n_all = vectors.where("n > 0").select(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    known = _document_counts(vectors).select("place", F.floor(1000 * F.log((F.lit(2.0) * n_texts + 2) / (2 * F.col("df") + 1))).alias("w")).toPandas()  # the vocabulary at most
    weights[known["place"].to_numpy(np.int64)] = known["w"].to_numpy(np.int64)
    names, numbers = np.unique(pairs["item_id"].to_numpy(), return_inverse=True)
    vectors_of = Items(numbers, places.astype(np.int32), weights[places])
    buckets = written(_impacts(vectors, n_texts, n_all).repartitionByRange(F.desc("length")).sortWithinPartitions(F.desc("length")), "buckets")
    edge = buckets.approxQuantile("length", [LONGEST], 0.005)
    least = np.zeros(len(names), np.int64)
    for row in _search(buckets.where(F.col("length") >= (edge[0] if edge else 0.0)), vectors_of, k, None).where(F.col("rank") == k).collect():  # a row per item
        least[row["item"]] = row["score"]
    name = texts.sparkSession.createDataFrame([(i, x) for i, x in enumerate(names.tolist())], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
    return _search(buckets, vectors_of, k, least).join(name, "item").select("item_id", "rank", "doc_id", "score")


def sql(k: int = 10) -> str:
    """The same search in DuckDB."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select doc_id, {words} ts from documents where text is not null),
s as (select count(*) texts, sum(len(ts))::bigint terms from d where len(ts) > 0),
i as (select distinct item_id, unnest({words}) t from benchmark where text is not null and item_id is not null),
c as (select doc_id, len(ts) n, unnest(ts) t from d),
p as (select doc_id, n, t, count(*) tf from c where t in (select t from i) group by all),
w as (select t, floor(1000 * ln((2.0::double * texts + 2) / (2 * count(*) + 1)))::bigint w from p, s group by t, texts),
r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * texts) // terms))))::bigint score
      from i join p using (t) join w using (t), s group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int rank, doc_id, score from r
where score > 0 and doc_id is not null qualify rank <= {k}"""
