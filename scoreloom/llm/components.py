"""Connected components of links between long ids, with DataFrame operations only.

Rounds of two star steps: every node hangs its larger neighbours on its smallest one,
then its smaller ones. Neighbour lists are never gathered; each step is a minimum with
partial sums and a join. Rounds end when the links no longer change; their number grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import written

MOST_ROUNDS = 60


def _summary(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (smallest id reachable) of every id that has a link to another id.

    Repeated links, links both ways and links to oneself change nothing; links with a null
    end are left out; no links give no rows.
    """
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = written(links.distinct(), "links")
    before = _summary(links)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _summary(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
