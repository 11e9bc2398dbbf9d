"""Near duplicates by bottom-k sketches of one hash function.

A text is its set of hashed word shingles. Equal sets form a class, and the class with
the smallest id speaks for all. The one hash function orders all shingles, so a sketch is
the first few of a set; shingles that fill long lists (HOT) come last in that order,
for everyone alike. They are found by counting low parts, somewhat longer than the prefixes,
and whole sets only of texts whose sketch leaves its low part; which shingles are HOT changes
the work, never the links. A pair above the threshold t must share one of the first
n - ceil(t n) + 1 shingles of either set, so those inverted lists miss no pair; sets with
a longer such prefix and at most a quarter of HOT shingles keep SKETCH of them, where the
chance of a miss is below 1e-14. A shared shingle counts only where its places leave enough
shingles behind it in both sets; since a template's shingles are HOT and come last, copies
that differ too much make no pair at all.

Pairs come from the lists in two steps, because only reachability is asked for:
each list's smallest id with every other (as many pairs as entries), then, once the
components of those links are known, pairs of different components. A large group of
near copies thus never makes all its pairs. Pairs that the union of two sketches puts
far below t are dropped; the others are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .components import components
from .stages import written
from .textblocks import SPACE_WORDS, Words, byte_values, chunks

SKETCH = 24
LOW_MOST = 2 * SKETCH  # shingles of a low part, the first of a set, which is counted to find HOT ones
HOT_FROM = 40  # entries of a list; doubled while more than HOT_MOST shingles pass
HOT_MOST = 500_000
SEND_MOST = 1_000_000  # ids that may be broadcast; beyond, a shuffled join


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, without words none."""
    for lo, hi in chunks(texts):
        words = Words(texts[lo:hi], SPACE_WORDS, lower=True)
        hashes, _ = words.windows(size)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(hashes[a:b - size + 1])
            elif b > a:
                yield np.array([int.from_bytes(hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=8).digest(), "little")], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of n of which one must be in the other set, if the similarity reaches the threshold."""
    return n - -(-percent * n // 100) + 1


def low_size(n: int, percent: int) -> int:
    """Shingles of the low part of a set of n: half as many again as its prefix has, up to LOW_MOST."""
    k = prefix_size(n, percent) if n else 0
    return min(k + k // 2, LOW_MOST)


def beyond_low(n: int, low: int, n_hot: int, percent: int) -> bool:
    """Whether a sketch of a set of n may reach beyond its low part, of which ``n_hot`` shingles of ``low`` are HOT.

    A fifth of HOT ones in the low part, rather than a quarter of the set, asks for the whole prefix.
    """
    k = prefix_size(n, percent) if n else 0
    return low - n_hot < (min(k, SKETCH) if 5 * n_hot < low else k)


def least_overlap(k: int, rate: float, risk: float = 1e-12) -> int:
    """Hits among k that all but ``risk`` of the sketches with this rate have."""
    total, m = 0.0, 0
    while m <= k:
        total += math.comb(k, m) * rate**m * (1 - rate) ** (k - m)
        if total > risk:
            return m
        m += 1
    return k


def _map(docs: DataFrame, id_col: str, text_col: str, size: int, fields: str, make) -> DataFrame:
    """One row per text: its id, then what ``make`` gives for its shingle set."""
    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(fields).fields])
    types = [f.type for f in to_arrow_schema(kind)][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(s) for s in shingle_sets(byte_values(batch.column(1)), size)]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=kind.names)

    return docs.select(id_col, text_col).mapInArrow(run, kind)


def _hot(values: DataFrame) -> DataFrame:
    """v, n of the shingles that more than HOT_FROM rows of ``values`` have."""
    return values.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > HOT_FROM)


def _most(counts: DataFrame) -> np.ndarray:
    """The shingles with the highest counts, at most HOT_MOST of them, sorted."""
    least = HOT_FROM
    while counts.where(F.col("n") > least).count() > HOT_MOST:
        least *= 2
    found = counts.where(F.col("n") > least).select("v").toPandas()["v"].to_numpy(np.int64)  # HOT_MOST at most
    return np.unique(found.view(np.uint64))


def _found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values stand in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _hot_shingles(docs: DataFrame, first: DataFrame, size: int, percent: int) -> np.ndarray:
    """HOT shingles: those that many low parts have and, of texts whose sketch reaches beyond the low part, those that many of these have."""
    counts = written(_hot(first.select(F.explode("low").alias("v"))), "hot")
    hot = docs.sparkSession.sparkContext.broadcast(_most(counts))

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [beyond_low(n.as_py(), len(x.values), int(_found(np.asarray(x.values).view(np.uint64), hot.value).sum()), percent) for n, x in zip(batch.column(1), batch.column(2), strict=True)]
            yield batch.select(["id"]).filter(pa.array(keep, pa.bool_()))

    warm = written(first.select("id", "n", "low").mapInArrow(beyond, first.select("id").schema).distinct(), "warm")
    every = _map(_of(warm, docs), "id", "text", size, "v array<long>", lambda s: (s.view(np.int64),))
    more = written(_hot(every.select(F.explode("v").alias("v"))), "hot")
    return _most(counts.unionAll(more).groupBy("v").agg(F.max("n").alias("n")))


def _of(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``table`` whose id is among ``ids`` (distinct)."""
    return table.join(F.broadcast(ids) if ids.count() <= SEND_MOST else ids, "id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _map(_of(ids, docs.withColumnRenamed(id_col, "id")), "id", text_col, size, "members binary", lambda s: (s.tobytes(),))
    sets = written(sets, "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, both.select("a", "b").schema).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles and component (smallest id reachable over links, itself included) of every text.

    Ids are whole numbers. A text without words, null included, is linked with nothing. Rows
    that share an id count as one node; a null id gives a row with a null component. Equal
    sets link, whatever their size. Extra columns play no part; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def look(s: np.ndarray) -> tuple:
        return len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, s[:low_size(len(s), percent)].view(np.int64)

    first = written(_map(docs, "id", "text", size, "n long, same binary, low array<long>", look), "first")
    classes = written(first.where("same is not null and id is not null").groupBy("same").agg(F.min("id").alias("speaker")), "classes")
    speakers = classes.select(F.col("speaker").alias("id"))
    hot = docs.sparkSession.sparkContext.broadcast(_hot_shingles(docs, _of(speakers, first), size, percent))

    def sketch(s: np.ndarray) -> tuple:
        warm = _found(s, hot.value)
        n_hot = int(warm.sum())
        k = prefix_size(len(s), percent) if len(s) else 0
        if 4 * n_hot < len(s):
            k = min(k, SKETCH)
        return len(s), n_hot, np.concatenate((s[~warm], s[warm]))[:k].view(np.int64)

    sketches = written(_map(_of(speakers, docs), "id", "text", size, "n long, n_hot long, kept array<long>", sketch), "sketches")
    posts = sketches.select("id", "n", F.posexplode("kept").alias("at", "v"))
    lists = posts.groupBy("v").agg(F.count("*").alias("entries"), F.min("id").alias("head"), F.min_by("n", "id").alias("n_a"), F.min_by("at", "id").alias("at_a"))
    posts = written(posts.join(lists.where("entries > 1").select("v", "head", "n_a", "at_a"), "v"), "posts")

    # The first shingle that both have stands at places that leave enough shingles behind them in either set.
    near = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    star = posts.where("id != head").withColumnsRenamed({"id": "b", "n": "n_b", "at": "at_b"}).where(near)
    star = written(star.select(F.col("head").alias("a"), "b").distinct(), "star")
    links = written(_confirmed(_likely(star, sketches, percent), docs, "id", "text", size, percent), "confirmed")

    labels = components(links)
    entry = posts.join(labels, "id", "left").select("v", "id", "n", "at", F.coalesce("component", "id").alias("c"))
    mixed = entry.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("v")
    entry = written(entry.join(mixed, "v").withColumn("step", F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100)).cast("int")), "entries")
    # sets within the threshold lie in the same or the next step of size
    left = entry.select("v", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("c").alias("c_a"), F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    right = entry.select("v", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("c").alias("c_b"), "step")
    cross = left.join(right, ["v", "step"]).where((F.col("c_a") < F.col("c_b")) & near).select("a", "b").distinct()
    cross = cross.join(star, ["a", "b"], "left_anti").join(star.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    more = _confirmed(_likely(cross, sketches, percent), docs, "id", "text", size, percent)
    whole = components(links.unionAll(more))

    home = classes.join(whole.withColumnRenamed("id", "speaker"), "speaker", "left").select("same", F.coalesce("component", "speaker").alias("component"))
    return first.join(home, "same", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs that the union of their sketches doesn't put far below the threshold."""
    s = sketches.select("id", "n", "n_hot", "kept")
    both = pairs.join(s.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in s.columns[1:]]), "a")
    both = both.join(s.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in s.columns[1:]]), "b")
    both = both.select("a", "b", "n_a", "n_b", "n_hot_a", "n_hot_b", "kept_a", "kept_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound: dict[int, int] = {}
        for batch in batches:
            n_a, n_b, hot_a, hot_b = (batch.column(i).to_numpy() for i in range(2, 6))
            clear = (hot_a * 20 <= n_a) & (hot_b * 20 <= n_b)
            keep = []
            for i in range(len(batch)):
                x, y = (np.asarray(batch.column(c)[i].values).view(np.uint64) for c in (6, 7))
                if not clear[i]:
                    keep.append(True)  # hot shingles stand at the end of the order, so this sketch is no sample
                    continue
                k = min(len(x), len(y))
                union = np.union1d(x, y)[:k]
                shared = int((np.isin(union, x) & np.isin(union, y)).sum())
                if k not in bound:
                    bound[k] = least_overlap(k, percent / 100 - 0.06)
                keep.append(shared >= bound[k])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, both.select("a", "b").schema).distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` but those whose group has a smaller id; rows that share an id leave one."""
    found = written(groups(docs, id_col, text_col, size, percent), "groups")
    drop = found.where("component < id").select(F.col("id").alias(id_col)).distinct()
    out = docs.join(F.broadcast(drop) if drop.count() <= SEND_MOST else drop, id_col, "left_anti").select(*docs.columns)
    again = found.where("id is not null").groupBy("id").count().where("count > 1")
    return out if again.isEmpty() else out.where(F.col(id_col).isNull()).unionAll(out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
