"""Jaccard join of word n-grams by parity sketches.

Every shingle of a text flips one bit of a wide sketch (its hash is the bit's place), so two
sketches differ in at most as many bits as their sets have elements apart. At a similarity of
t or more that is at most (1 - t)/(1 + t) of both sizes together. The sketch is cut into
blocks; a block is known by the XOR of hashes of its set bits. A shingle touches one block, so
of the blocks that are not empty in a set of n at most n (1 - t)/t differ from any partner's:
all others (``need`` of them) are shared. Blocks are the keys of a join.

Sets are treated in bands of size, each twice as large as the one before; a set near the lower
end of its band also enters the band below, so any two sets within the threshold share a band.
A band has about as many blocks as its smallest sets have shingles (the smallest band: one per
shingle). From 128 shingles on, a band takes a fixed share of all hashes, so its sets have 64
to 160 shingles left, and ``need`` becomes the number that a pair at the threshold shares but
for odds of about 1e-11; the same odds are those of crowding below that size. Nothing else is
left out.

Per text, only the rarest blocks are joined: of at least ``need`` shared ones, ``need`` - 1 can
be spared, and a text with fewer than ``need`` blocks that any other text has is done. A text of
which a common passage is a small part thus never meets the others that hold it. Texts hang on
the smallest id of a list first; then, once the components are known, lists whose texts are
in different components are worked through, with the Hamming distance of 1,024-bit folded
sketches as the join's condition. Sets of fewer than 512 shingles are folded whole, so that
condition is the bound itself; larger ones by a share of 256 to 640. A pair comes from the
first list that both texts are in. What is left is confirmed on full sets: the nearest pair of
two components, then a few, then all others, each step without the components that the one
before has linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .minhash import shingle_sets
from .stages import written
from .textblocks import byte_values, mix

FOLDED = 1024  # bits
WORDS = FOLDED // 64
WHOLE = 4  # the largest band whose sets are folded whole
SMALL = 32  # sets below have one block per shingle
SAMPLED = 128  # sets of this size and more enter with a share of their shingles
BLOCKS = 64
SHARED = 6  # blocks that a sampled pair at a threshold of 0.8 shares: fewer with odds of 1e-11
SPREAD = 2.1  # folded sketches of a sampled pair: slack in square roots of both sizes, seven deviations
NEXT = 16  # pairs of two components that are confirmed at once when the nearest one wasn't enough
_U = np.uint64


def bands(n: int, percent: int) -> list[int]:
    """Bands of a set of n shingles: b holds sizes of SMALL * 2^(b-1) to twice that, 0 all below."""
    own = max(0, (n // SMALL).bit_length())
    low = SMALL << (own - 1) if own else 0
    return [own - 1, own] if own and percent * n < 100 * low else [own]


def needed(n: int, blocks: int, percent: int) -> int:
    """Blocks of ``blocks`` that are not empty which every partner of a set of n shares, 1 at least."""
    return max(1, blocks - n * (100 - percent) // percent)


def shared_least(percent: int) -> int:
    """``SHARED`` holds down to 80 percent; below, sampled pairs share fewer blocks."""
    return SHARED if percent >= 80 else 1


def sketch(s: np.ndarray, band: int, percent: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Shingles folded, need, keys of the blocks that are not empty, and the folded sketch of sorted hashes in a band."""
    low = SMALL << (band - 1) if band else 0
    shift = max(0, band - 2)  # the band from 64 on takes all, each above half of the one below
    part = lambda shift: s[: np.searchsorted(s, _U((1 << (64 - shift)) - 1), side="right")] if shift else s
    folded = part(max(0, band - WHOLE))
    where = (mix(folded) >> _U(3)) & _U(FOLDED - 1)
    bits = np.packbits((np.bincount(where.astype(np.int64), minlength=FOLDED) & 1).astype(np.uint8)).view(np.int64)
    spread = mix(part(shift))
    if not band:
        keys = spread
    else:
        count = min(low, BLOCKS)
        block = (spread >> _U(50)) % _U(count)
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
        parity = np.bitwise_xor.reduceat(mix(spread[order] + _U(1)), first) if len(block) else np.zeros(0, np.uint64)
        keys = parity[parity != 0] ^ mix(block[first][parity != 0] + _U(1 << 20))
    keys = mix(keys + _U(band * 0x9E3779B1 + 7))
    need = needed(len(s), len(keys), percent) if not shift else min(shared_least(percent), max(1, len(keys)))
    return len(folded), need, keys.view(np.int64), bits


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of (id, text): a row per text and band with id, n, same (digest of the set), main (one row per text), band, m, need, keys, bits."""
    kind = T.StructType([T.StructField("id", docs.schema["id"].dataType), *T._parse_datatype_string("n long, same binary, main boolean, band int, m int, need int, keys array<long>, bits array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, s in enumerate(shingle_sets(byte_values(batch.column(1)), size)):
                if not len(s):
                    ids.append(i)
                    rows.append((0, None, True, None, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    continue
                same = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                for k, band in enumerate(bands(len(s), percent)):
                    m, need, keys, bits = sketch(s, band, percent)
                    ids.append(i)
                    rows.append((len(s), same, not k, band, m, need, keys, bits))
            if not rows:
                continue
            n, same, main, band, m, need, keys, bits = zip(*rows, strict=True)
            lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(main, pa.bool_()), pa.array(band, pa.int32()),
                                              pa.array(m, pa.int32()), pa.array(need, pa.int32()), lists(keys), lists(bits)], names=kind.names)

    return docs.mapInArrow(run, kind)


def _apart():
    """Hamming distance of the folded sketches bits_a0.. and bits_b0.."""
    return reduce(add, [F.bit_count(F.col(f"bits_a{i}").bitwiseXOR(F.col(f"bits_b{i}"))) for i in range(WORDS)])


def _near(percent: int):
    """Whether the folded sketches of a band leave the threshold possible."""
    both = F.col("m_a") + F.col("m_b")
    whole = (F.col("m_a") == F.col("n_a")) & (F.col("m_b") == F.col("n_b"))
    slack = F.when(whole, 0.0).otherwise(F.sqrt(both.cast("double")) * SPREAD)
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return sizes & (_apart() * (100 + percent) <= both * (100 - percent) + slack * (100 + percent))


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. Of an id with several texts, any may."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    kind = T.StructType([docs.schema["id"], T.StructField("members", T.BinaryType())])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(byte_values(batch.column(1)), size)], pa.binary())], names=["id", "members"])

    sets = written(docs.join(ids, "id", "left_semi").select("id", "text").mapInArrow(members, kind), "sets")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                shared = int((y[at] == x).sum()) if len(x) else 0
                keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.mapInArrow(run, both.select("a", "b").schema).distinct(), "confirmed")


def rare_blocks(speakers: DataFrame) -> DataFrame:
    """id, band, v of the blocks by which texts are joined: those that other texts have too, without the ``need`` - 1 commonest."""
    posts = speakers.select("id", F.col("band") * 1024 + F.col("need"), F.explode("keys")).toDF("id", "slot", "v")
    lists = posts.groupBy("v").agg(F.count("*").alias("entries"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("v", "entries")
    shared = posts.join(lists, "v")
    mine = Window.partitionBy("id", "slot")
    ranked = shared.withColumn("place", F.row_number().over(mine.orderBy("entries", "v"))).withColumn("there", F.count("*").over(mine))
    kept = ranked.where(F.col("place") <= F.col("there") - F.col("slot") % 1024 + 1)
    return kept.select("id", F.floor(F.col("slot") / 1024).cast("int").alias("band"), "v").distinct()


def nearest_pairs(cross: DataFrame, share: int) -> DataFrame:
    """Of the pairs between two components, the one with the nearest sketches in each of ``share`` parts."""
    best = cross.groupBy("c_a", "c_b", F.pmod(F.xxhash64("a", "b"), F.lit(share)).alias("part")).agg(F.min(F.struct("apart", "a", "b")).alias("best"))
    return best.select("best.a", "best.b")


def still_apart(cross: DataFrame, whole: DataFrame) -> DataFrame:
    """Pairs whose components are not yet linked, named by the components as they are now."""
    for end in ("a", "b"):
        now = whole.select(F.col("c_speaker").alias(f"c_{end}"), F.col("c").alias("now"))
        cross = cross.join(now, f"c_{end}", "left").withColumn(f"c_{end}", F.coalesce("now", f"c_{end}")).drop("now")
    names = {"c_a": F.least("c_a", "c_b"), "c_b": F.greatest("c_a", "c_b")}
    return cross.where("c_a <> c_b").select("a", "b", "apart", *[c.alias(n) for n, c in names.items()])


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles and component (smallest id reachable over links, itself included) of every text.

    Ids are whole numbers. Words are separated by white space, A-Z lower-cased; a text with fewer words
    than ``size`` is one shingle. A text without words, null included, is linked with nothing. Equal sets
    link. Rows that share an id are one node with a row each (those without words stay alone); a null id gives a
    row with a null component. Very long texts enter whole. There are no ties to break: any link counts. Extra columns play no part;
    an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drawn = written(sketches(docs, size, percent), "sketches")
    first = drawn.where("main").select("id", "n", "same")
    classes = written(first.where("same is not null and id is not null").groupBy("same").agg(F.min("id").alias("speaker")), "classes")
    bits = ["id", "band", "n", "m", *[f"bits{i}" for i in range(WORDS)]]
    flat = drawn.where("same is not null").select("same", "id", "band", "n", "m", "need", "keys", *[F.col("bits")[i].alias(f"bits{i}") for i in range(WORDS)])
    speakers = written(flat.join(classes.withColumnRenamed("speaker", "id"), ["same", "id"], "left_semi"), "speakers")
    speaks = speakers.select(*bits)
    kept = written(rare_blocks(speakers), "blocks")
    several = first.where("same is not null").groupBy("id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo < hi").select("id")
    bridges = first.join(several, "id").join(classes, "same").where("id <> speaker").select(F.col("id").alias("a"), F.col("speaker").alias("b"))

    ended = lambda c, end: f"bits_{end}{c[4:]}" if c.startswith("bits") else {"id": end, "band": c, "v": c}.get(c, f"{c}_{end}")
    of = lambda end: speaks.select(*[F.col(c).alias(ended(c, end)) for c in bits])
    heads = kept.groupBy("v").agg(F.min("id").alias("a"), F.count("*").alias("entries")).where("entries > 1").select("v", "a")
    star = kept.join(heads, "v").where("id > a").select("a", F.col("id").alias("b"), "band").distinct()
    star = star.join(of("b"), ["b", "band"]).join(of("a"), ["a", "band"]).where(_near(percent))
    star = written(star.select("a", "b").distinct(), "star")
    labels = written(components(confirmed(star, docs, size, percent)), "labels")

    entry = kept.join(labels, "id", "left").select("v", "band", "id", F.coalesce("component", "id").alias("c"))
    mixed = entry.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("v")
    lower = Window.partitionBy("id", "band").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    entry = entry.join(mixed, "v").withColumn("lower", F.collect_list("v").over(lower))
    entry = written(entry.join(speaks, ["id", "band"]), "entries")
    end = lambda e: entry.select(*[F.col(c).alias(ended(c, e)) for c in ("v", "c", "lower", *bits) if c != "band"])
    # a pair comes from the first of its common lists alone
    cross = end("a").join(end("b"), "v").where((F.col("c_a") < F.col("c_b")) & _near(percent) & ~F.arrays_overlap("lower_a", "lower_b"))
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (_apart() / (F.col("m_a") + F.col("m_b"))).alias("apart"))
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = cross.groupBy("a", "b").agg(F.min("apart").alias("apart")).join(tried, ["a", "b"], "left_anti")
    # what is new links components, not texts
    label = lambda t, end: t.join(labels.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}")), end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    of_components = lambda t: label(label(t, "a"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    cross = written(label(label(cross, "a"), "b"), "cross")
    new = of_components(bridges)
    for share in (1, NEXT, None):
        some = cross if share is None else nearest_pairs(cross, share)
        new = new.unionAll(of_components(confirmed(some.select("a", "b"), docs, size, percent)))
        whole = written(components(new).withColumnsRenamed({"id": "c_speaker", "component": "c"}), "whole")
        if share:
            cross = written(still_apart(cross.join(some, ["a", "b"], "left_anti"), whole), "cross")

    home = label(classes, "speaker").join(whole, "c_speaker", "left").select("same", F.coalesce("c", "c_speaker").alias("component"))
    return first.join(home, "same", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
