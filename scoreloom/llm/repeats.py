"""Stretches of texts that occur elsewhere: how candidates are found and dealt out.

A *window* is W consecutive units (bytes or words) of one text. Its key is the smallest
hash of the k-unit grams inside, so equal windows have equal keys wherever they stand.
Neighbouring windows with one key make a *run* of at most RUN windows, and a run's
stretch of units is a segment. Runs whose key occurs once hold no repeat and go.

Segments with equal content need to be looked at once: the earliest speaks for all, and
later ones are repeats as a whole. A speaker that shares its key with no other content and
can't repeat itself has nothing to be compared with (``sieve``). The speakers of a key are given, with their text, to
a ``finder``, which marks the windows that occur earlier. A key with more than ``most``
different segments is dealt out again by grams of more units; the last level is the
whole window, where one segment a key is left, so no key ends as one large task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import written
from .textblocks import BASE, SPACE_WORDS, WORD_BASE, Bytes, Prefix, Words, byte_values, chunks, mix, window_minimum

RUN = 128
MOST_SEGMENTS = 4096
SEND_MOST = 1_000_000
BLOCK_BYTES = 1 << 20  # text of the segments that one finder call gets, but for one larger key

POST = "key long, content long, id long, at long, n int, again boolean, twice boolean"
PIECE = "key long, id long, at long, n int, piece binary"
COVER = "id long, begin long, end long"


@dataclass(frozen=True)
class Kind:
    """What windows are made of. ``within``: an earlier start in the same text counts too.
    ``sieve``: all speakers are dealt out again by the second grams before a finder gets them,
    and keys left with one content that doesn't repeat itself go."""

    window: int
    grams: tuple[int, ...]
    words: bool
    within: bool
    sieve: bool = False

    def units(self, texts: list[bytes]) -> Units:
        return Units(self, texts)


class Units:
    """Units of joined texts; text i has units ``begin[i]:end[i]``."""

    def __init__(self, kind: Kind, texts: list[bytes]):
        self.kind = kind
        if kind.words:
            self.words = Words(texts, SPACE_WORDS)
            self.begin, self.end = self.words.first[:-1], self.words.first[1:]
            self.values = self.words.hash
            self.prefix = Prefix(self.values, WORD_BASE)
            self.data = self.words.bytes.data
        else:
            block = Bytes(texts)
            self.begin, self.end, self.data = block.begin, block.end, block.data
            self.values = self.data
            self.prefix = Prefix(self.data + np.uint64(1), BASE)

    def runs(self, gram: int) -> tuple[np.ndarray, ...]:
        """text, start (in all units), windows, key and content of every run."""
        w = self.kind.window
        grams = self.prefix.every(gram)
        keys = window_minimum(grams, w - gram + 1)
        limit = np.maximum(self.begin, self.end - w + 1)  # the first start that leaves the text
        cuts = np.concatenate((np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else np.zeros(0, int), self.begin, limit))
        cuts = np.append(np.unique(cuts[cuts < len(keys)]), len(keys))
        start, size = cuts[:-1], np.diff(cuts)
        text = np.searchsorted(self.begin, start, side="right") - 1
        inside = (text >= 0) & (start < limit[text]) & (size > 0)
        text, start, size = text[inside], start[inside], size[inside]
        parts = -(-size // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        text, start, size = (np.repeat(x, parts) for x in (text, start, size))
        start, size = start + nth * RUN, np.minimum(size - nth * RUN, RUN)
        return text, start, size, keys[start], mix(self.prefix.span(start, start + size + w - 1))

    def doubled(self, gram: int, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Runs in which the key's gram stands more than once, so that windows of one run can be equal."""
        reach = self.kind.window - gram
        grams = self.prefix.every(gram)
        edge = np.zeros(reach, np.uint64)
        keys = window_minimum(grams, reach + 1)
        most = ~window_minimum(~np.concatenate((edge, keys, edge)), reach + 1) if len(keys) else keys
        place = np.flatnonzero(grams[:len(most)] == most)  # grams that are the key of some window
        values, rank = np.unique(grams[place], return_inverse=True)
        sorted_places = np.sort((rank << 32) + place)
        mine = np.searchsorted(values, key) << 32
        return np.searchsorted(sorted_places, mine + start + size + reach) - np.searchsorted(sorted_places, mine + start) > 1

    def piece(self, start: int, n_units: int) -> bytes:
        if not self.kind.words:
            return self.data[start:start + n_units].tobytes()
        w = self.words
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(w.start[start:start + n_units].tolist(), w.end[start:start + n_units].tolist(), strict=True))


def _arrow(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def key_counts(docs: DataFrame, kind: Kind) -> DataFrame:
    """Keys with more than one run, or one that may repeat itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch.column(0))
            for lo, hi in chunks(texts):
                units = kind.units(texts[lo:hi])
                _, start, size, key, _ = units.runs(kind.grams[0])
                twice = units.doubled(kind.grams[0], start, size, key) if kind.within else np.zeros(len(key), bool)
                keys, counts = np.unique(np.concatenate((key, key[twice])), return_counts=True)
                yield _arrow(["key", "runs"], _signed(keys), counts)

    found = docs.select("text").mapInArrow(run, "key long, runs long")
    return found.groupBy("key").agg(F.sum("runs").alias("runs")).where("runs > 1").select("key")


def posts(docs: DataFrame, kind: Kind) -> DataFrame:
    """All runs; ``again`` marks a content that stands earlier in the same text (if such count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = byte_values(batch.column(1)), batch.column(0).to_numpy()
            for lo, hi in chunks(texts):
                units = kind.units(texts[lo:hi])
                text, start, size, key, content = units.runs(kind.grams[0])
                again, twice = np.zeros(len(text), bool), np.zeros(len(text), bool)
                if kind.within and len(text):
                    twice = units.doubled(kind.grams[0], start, size, key)
                    order = np.lexsort((start, content, key, text))
                    same = (text[order][1:] == text[order][:-1]) & (key[order][1:] == key[order][:-1]) & (content[order][1:] == content[order][:-1])
                    again[order[1:]] = same
                yield _arrow(["key", "content", "id", "at", "n", "again", "twice"], _signed(key), _signed(content), ids[lo:hi][text], start - units.begin[text], size.astype(np.int32), again, twice)

    return docs.select("id", "text").mapInArrow(run, POST)


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs that ``wanted`` (one row per id) speaks of, with its columns; other texts aren't shuffled
    where the ids are few enough to be sent."""
    ids = wanted.select("id")
    if ids.count() <= SEND_MOST:
        docs = docs.join(F.broadcast(ids), "id", "left_semi")
    return docs.join(wanted.hint("shuffle_hash"), "id")


def pieces(docs: DataFrame, speakers: DataFrame, kind: Kind) -> DataFrame:
    """The text of each speaker's segment."""
    wanted = written(speakers.groupBy("id").agg(F.collect_list(F.struct("key", "at", "n")).alias("parts")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, parts = byte_values(batch.column(1)), batch.column(0).to_pylist(), batch.column(2)
            for i in range(len(texts)):
                units, these = kind.units([texts[i]]), parts[i].values
                key, at, n = these.field("key"), these.field("at").to_numpy(), these.field("n").to_numpy()
                yield _arrow(["key", "id", "at", "n", "piece"], key, np.full(len(at), ids[i], np.int64), at, n, pa.array([units.piece(a, m + kind.window - 1) for a, m in zip(at.tolist(), n.tolist(), strict=True)], pa.binary()))

    return _with_text(docs.select("id", "text"), wanted).select("id", "text", "parts").mapInArrow(_merged(run), PIECE)


def _merged(run: Callable, rows: int = 4096) -> Callable:
    """Small batches joined to larger ones."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += len(b)
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return wrapped


def refine(segments: DataFrame, kind: Kind, gram: int) -> DataFrame:
    """Segments cut into runs by grams of more units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(4).to_pylist()
            old, ids, base = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, hi in chunks(found):
                units = kind.units(found[lo:hi])
                text, start, size, key, content = units.runs(gram)
                twice = units.doubled(gram, start, size, key) if kind.within else np.zeros(len(key), bool)
                key = mix(key ^ mix(old[lo:hi].view(np.uint64)[text] + np.uint64(gram)))
                part = pa.array([units.piece(a, m + kind.window - 1) for a, m in zip(start.tolist(), size.tolist(), strict=True)], pa.binary())
                yield _arrow(["key", "content", "id", "at", "n", "piece", "twice"], _signed(key), _signed(content), ids[lo:hi][text], base[lo:hi][text] + start - units.begin[text], size.astype(np.int32), part, twice)

    return segments.mapInArrow(run, "key long, content long, id long, at long, n int, piece binary, twice boolean")


def search(segments: DataFrame, kind: Kind, finder: Callable) -> DataFrame:
    """Stretches of the segments that ``finder`` marks. Keys lie together in a task and are
    handed over in blocks of about BLOCK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def found() -> pa.RecordBatch:
            ids, at, n, part = zip(*((r[1], r[2], r[3], r[4]) for r in held), strict=True)
            return _arrow(["id", "begin", "end"], *finder(np.array(ids, np.int64), np.array(at, np.int64), np.array(n, np.int64), list(part)))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield found()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield found()

    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(parts, "key").sortWithinPartitions("key", "id", "at").mapInArrow(run, COVER)


def _whole(rows: DataFrame, kind: Kind) -> DataFrame:
    return rows.select("id", F.col("at").alias("begin"), (F.col("at") + F.col("n") + kind.window - 1).alias("end"))


def _alone(classes: DataFrame) -> DataFrame:
    """Keys with one content, which doesn't repeat itself: a segment that nothing can be found in."""
    return classes.groupBy("key").agg(F.count("*").alias("contents"), F.max("doubled").alias("doubled")).where("contents = 1 and not doubled")


def covers(docs: DataFrame, kind: Kind, finder: Callable, most: int = MOST_SEGMENTS) -> DataFrame:
    """id, spans (maximal stretches of units in windows that occur earlier) of texts that have any.

    ``docs`` has unique long ids and texts.
    """
    keys = key_counts(docs, kind)
    found = written(posts(docs, kind).join(keys, "key"), "posts")
    classes = found.groupBy("key", "content").agg(F.min("id").alias("first"), F.max("twice").alias("doubled"))
    if kind.sieve:
        alone = _alone(classes).select("key")
        speaks = classes.join(alone, "key", "left_anti").select("key", "content", F.lit(True).alias("needed"))
        classes = classes.join(speaks, ["key", "content"], "left").withColumn("needed", F.coalesce("needed", F.lit(False)))
    else:
        classes = classes.withColumn("needed", F.lit(True))
    found = found.join(classes, ["key", "content"])
    later = (F.col("id") > F.col("first")) | F.col("again")
    out = [_whole(found.where(later), kind)]
    segments = written(pieces(docs, found.where(~later & F.col("needed")).select("id", "key", "at", "n"), kind), "segments")
    for level, gram in enumerate(kind.grams[1:]):
        if kind.sieve and level == 0:
            finer = refine(segments, kind, gram)
        else:
            crowded = segments.groupBy("key").count().where(F.col("count") > most).select("key")
            crowded = written(crowded, "crowded")
            if crowded.isEmpty():
                break
            out.append(search(segments.join(crowded, "key", "left_anti"), kind, finder))
            finer = refine(segments.join(crowded, "key", "left_semi"), kind, gram)
        finer = written(finer, "finer")
        first = F.min(F.struct("id", "at")) if kind.within else F.struct(F.min("id").alias("id"))
        classes = finer.groupBy("key", "content").agg(first.alias("first"), F.max("twice").alias("doubled"))
        finer = finer.join(classes, ["key", "content"])
        later = (F.col("id") > F.col("first.id")) | ((F.col("at") > F.col("first.at")) if kind.within else F.lit(False))
        out.append(_whole(finer.where(later), kind))
        rest = finer.where(~later)
        if kind.sieve:
            rest = rest.join(_alone(classes).select("key"), "key", "left_anti")
        segments = written(rest.select("key", "id", "at", "n", "piece"), "segments")
    out.append(search(segments, kind, finder))
    every = out[0]
    for more in out[1:]:
        every = every.unionAll(more)
    return written(_joined(every), "covers")


def _joined(stretches: DataFrame) -> DataFrame:
    """Stretches of each id joined to maximal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for row in batch.column(1):
                begin, end = row.values.field("begin").to_numpy(), row.values.field("end").to_numpy()
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.append(True, begin[1:] > end[:-1])
                out.append([{"begin": a, "end": b} for a, b in zip(begin[new].tolist(), end[np.append(new[1:], True)].tolist(), strict=True)])
            yield _arrow(["id", "spans"], batch.column(0), pa.array(out, span))

    return stretches.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("all")).mapInArrow(run, "id long, spans array<struct<begin:long,end:long>>")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with unique long ids in the order of ``id_col``, and the old ids where they had to change.

    Null or repeated ids: distinct (id, text) rows are numbered by id (null first), then text,
    so that rows with one id are documents of their own and equal rows are one.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, known = plain.select(F.count("*"), F.count("id")).first()
    if n == known and isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType)) and plain.groupBy("id").count().where("count > 1").isEmpty():
        return plain.withColumn("id", F.col("id").cast("long")), None
    rows = plain.distinct().sort("id", "text").rdd.zipWithIndex().map(lambda x: (x[1], x[0][0], x[0][1]))
    fields = [T.StructField("id", T.LongType()), T.StructField("old", docs.schema[id_col].dataType), T.StructField("text", T.StringType())]
    rows = written(docs.sparkSession.createDataFrame(rows, T.StructType(fields)), "numbered")
    return rows.select("id", "text"), rows


def spans(docs: DataFrame, id_col: str, text_col: str, kind: Kind, finder: Callable, most: int = MOST_SEGMENTS) -> DataFrame:
    """The id and text of every row of ``docs`` and its spans (empty array: none)."""
    plain, changed = numbered(docs, id_col, text_col)
    found = covers(plain, kind, finder, most)
    none = F.expr("cast(array() as array<struct<begin:long,end:long>>)")
    ids = found.select("id")
    if changed is None and ids.count() <= SEND_MOST:  # texts without a span stay where they are
        rest = plain.join(F.broadcast(ids), "id", "left_anti").withColumn("spans", none)
        out = _with_text(plain, found).select("id", "text", "spans").unionAll(rest)
        return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
    out = plain.join(found, "id", "left").withColumn("spans", F.coalesce("spans", none))
    if changed is None:
        return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
    every = docs.select(F.col(id_col).alias("old"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    same = changed.select("old", F.col("text").alias("_t"), F.col("id").alias("_n"))
    every = every.join(same, every["old"].eqNullSafe(same["old"]) & (every["text"] == same["_t"])).select(every["old"], "text", "_n")
    return every.join(out.select(F.col("id").alias("_n"), "spans"), "_n").select(F.col("old").alias(id_col), F.col("text").alias(text_col), "spans")
