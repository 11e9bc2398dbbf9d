"""Conversation layouts and packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numerics import key_hash
from ..functions.text import word_count

MESSAGE = "array<struct<role: string, content: string>>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def instructions_to_chat(df: DataFrame, history: str = "history", prompt: str = "prompt", query: str = "query", response: str = "response",
                         chosen: str | None = None, rejected: str | None = None, tag: str | None = None, system: str | None = None) -> DataFrame:
    """``messages`` and ``responses`` from instruction rows: earlier exchanges, then
    prompt and query joined by a line break; a preference pair or a tagged reply as two responses."""
    past = F.flatten(F.transform(F.coalesce(history, F.expr("array()").cast("array<struct<p: string, r: string>>")),
                                 lambda h: F.array(_message("user", h["p"]), _message("assistant", h["r"]))))
    asked = F.array_join(F.filter(F.array(prompt, query), lambda x: x.isNotNull() & (x != "")), "\n")
    reply = F.array(_message("assistant", F.col(response)))
    out = F.when(F.col(response).isNotNull(), reply).otherwise(F.expr("array()").cast(MESSAGE))
    if chosen and rejected:
        out = F.when(F.col(chosen).isNotNull() & F.col(rejected).isNotNull(), F.array(_message("assistant", F.col(chosen)), _message("assistant", F.col(rejected)))).otherwise(out)
    if tag:
        empty = F.array(_message("assistant", F.lit("")))
        out = F.when(F.col(tag), F.concat(reply, empty)).when(~F.col(tag), F.concat(empty, reply)).otherwise(out)
    return df.select("*", F.concat(past, F.array(_message("user", asked))).alias("messages"), out.alias("responses"),
                     F.coalesce(F.col(system) if system else F.lit(None), F.lit("")).alias("system"))


def conversations_to_chat(df: DataFrame, turns: str = "turns", ranking: bool = False) -> DataFrame:
    """``system``, ``messages``, ``responses`` from ordered turns (role, value).

    A leading system turn is split off; user (or observation) and assistant (or
    function) turns must alternate and close with a reply. Broken conversations
    get empty lists and are told apart by ``broken``.
    """
    lead = F.size(turns) > 0
    lead = lead & (F.try_element_at(F.col(turns), F.lit(1))["role"] == "system")
    system = F.when(lead, F.try_element_at(F.col(turns), F.lit(1))["value"]).otherwise("")
    rows = df.withColumn("system", system).withColumn("_t", F.when(lead, F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(F.col(turns)))
    tagged = F.transform("_t", lambda x, i: F.when(i % 2 == 0, x["role"].isin("user", "observation")).otherwise(x["role"].isin("assistant", "function")))
    good = F.forall(tagged, lambda ok: F.coalesce(ok, F.lit(False))) & ((F.size("_t") % 2 == 1) if ranking else (F.size("_t") % 2 == 0)) & (F.size("_t") > 0)
    message = F.transform("_t", lambda x: F.struct(x["role"].alias("role"), x["value"].alias("content")))
    none = F.expr("array()").cast(MESSAGE)
    n = F.size("_t")
    return rows.select("*", (~good).alias("broken"), F.when(good, F.slice(message, 1, F.greatest(n - 1, F.lit(0)))).otherwise(none).alias("messages"),
                       F.when(good, F.slice(message, F.greatest(n, F.lit(1)), 1)).otherwise(none).alias("responses")).drop("_t")


def usable_examples(df: DataFrame) -> DataFrame:
    return df.where((F.size("messages") % 2 == 1) & (F.size("responses") == 1))


def example_length(df: DataFrame) -> Column:
    count = lambda c: F.aggregate(F.transform(c, lambda m: word_count(m["content"])), F.lit(0), lambda a, x: a + x)
    return count("messages") + count("responses")


class Rooms:
    """Free room of numbered sequences as a tree of largest rooms: the first with enough room is found in log time."""

    def __init__(self, n: int, cutoff: int):
        self.width = 1 << max(0, n - 1).bit_length()
        self.tree = [cutoff] * (2 * self.width)

    def take(self, size: int) -> int:
        """Number of the first sequence with room for ``size``, which it then has less."""
        spot = 1
        while spot < self.width:
            spot *= 2
            if self.tree[spot] < size:
                spot += 1
        self.tree[spot] -= size
        found = spot - self.width
        while spot > 1:
            spot //= 2
            self.tree[spot] = max(self.tree[2 * spot], self.tree[2 * spot + 1])
        return found


def pack(df: DataFrame, key: str, length: str, cutoff: int, buckets: int, most: int = 1_000_000) -> DataFrame:
    """Put examples into sequences of at most ``cutoff`` words; longer ones are dropped.

    Examples are spread by key hash over ``buckets`` buckets and filled largest first, each into
    the first sequence with room. Adds bucket, sequence, place in the sequence; positions restart
    with every example. The number of buckets is the caller's, so an example's bucket does not change
    when the table grows; a bucket of more than ``most`` rows is refused.
    """
    short = df.where(F.col(length) <= cutoff).select(key, length)
    placed = short.withColumn("bucket", (key_hash("pack", F.col(key)) % buckets).cast("int"))
    largest = placed.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a bucket has {largest} rows, more than {most}: ask for more than {buckets} buckets")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, key], ascending=[False, True])
        rooms = Rooms(len(pdf), cutoff)
        seq = np.array([rooms.take(size) for size in pdf[length].tolist()], np.int64)
        pdf = pdf.assign(sequence=seq)
        return pdf.assign(place=pdf.groupby("sequence").cumcount())

    kind = {f.name: f.dataType.simpleString() for f in placed.schema}
    return placed.groupBy("bucket").applyInPandas(fill, f"`{key}` {kind[key]}, `{length}` {kind[length]}, bucket int, sequence int, place int")
