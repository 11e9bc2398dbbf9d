"""Versioned training sets: stage, gate, publish at once.

Data goes to a folder of its own first. Only when its gates hold does a manifest appear under
the version's name, in one rename; readers know a version by its manifest alone. A failed or
interrupted build leaves nothing that a reader sees, and can be run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .assembly import holdout_split
from .staging import staged

# Lower bounds of the shares of a quality distribution, best first.
QUALITY = (("excellent", 4.5), ("good", 3.5), ("fair", 2.5), ("poor", 1.5), ("bad", None))


class GateFailed(ValueError):
    """The data of a version breaks a gate; ``report`` says which."""

    def __init__(self, report: dict):
        super().__init__(f"gates failed: {', '.join(k for k, v in report.items() if v is False)}")
        self.report = report


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, hadoop.Path


def _manifest_path(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/manifests/{version}.json"


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file under its final name in one rename; a name that is taken is refused."""
    files, final, at = _files(spark, path)
    draft = at(f"{path}.{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):  # another writer was first
        files.delete(draft, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, None where there is none."""
    files, at, _ = _files(spark, path)
    if not files.exists(at):
        return None
    return spark.read.text(path, wholetext=True).first().value


def names_in(spark: SparkSession, folder: str) -> list[str]:
    files, at, _ = _files(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def read_manifest(spark: SparkSession, root: str, version: str) -> dict | None:
    """The manifest of a published version, else None."""
    text = read_text(spark, _manifest_path(root, version))
    return None if text is None else json.loads(text)


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The rows of a published version, training and holdout (``part``)."""
    manifest = read_manifest(spark, root, version)
    if manifest is None:
        raise FileNotFoundError(f"version {version} is not published")
    return spark.read.parquet(manifest["data"])


def level_shares(rows: DataFrame, probs: str = "level_probs") -> list[float]:
    """Share of the label mass per level, best first."""
    sums = rows.agg(*[F.sum(F.col(probs)[i]).alias(f"p{i}") for i in range(5)]).first()
    total = sum(v or 0.0 for v in sums)
    return [(v or 0.0) / total if total else 0.0 for v in sums]


def quality_summary(rows: DataFrame, score: str) -> dict:
    """Percent of rows per quality range, and mean, deviation and ends of the scores."""
    g, above, aggs = F.col(score), None, []
    for name, low in QUALITY:
        here = F.lit(True) if low is None else g >= low
        mine = here if above is None else here & (g < above)
        aggs.append((F.avg(mine.cast("int")) * 100).alias(f"{name}_pct"))
        above = low
    row = rows.agg(*aggs, F.avg(g).alias("mos_mean"), F.stddev_pop(g).alias("mos_std"), F.min(g).alias("mos_min"), F.max(g).alias("mos_max")).first()
    return row.asDict()


def build_version(root: str, version: str, base: DataFrame, streams: Sequence[DataFrame], parent: str | None = None, tier: int = 1, key: str = "image_id", score: str = "mos",
                  holdout: float = 0.10, level_mass_min: float = 0.02, gates: dict[str, bool] | None = None, seed=42, description: str = "") -> dict:
    """Publish ``version``: base rows and expansion streams, a share of each stream's sources held out.

    ``base`` and ``streams`` have ``key``, ``score``, level_probs, source, stream, label_method, weight and cost.
    Every level must hold ``level_mass_min`` of the training rows' label mass; ``gates`` are further
    results, decided outside. Returns the manifest, or raises ``GateFailed`` and publishes nothing.
    """
    spark = base.sparkSession
    expansion = staged(streams[0] if len(streams) == 1 else _union(streams), "streams")
    split = holdout_split(expansion, key, "source", holdout, seed)
    rows = base.withColumn("part", F.lit("train")).unionByName(split.select(*base.columns, "part"))
    folder = f"{root.rstrip('/')}/data/{version}-{uuid.uuid4().hex}"
    rows.write.partitionBy("part").parquet(folder)
    data = spark.read.schema(rows.schema).parquet(folder)
    train = data.where(F.col("part") == "train")
    shares = level_shares(train)
    report = {"level_mass_pct_min": level_mass_min * 100, "level_gate_passed": all(s >= level_mass_min for s in shares), **(gates or {})}
    if any(v is False for v in report.values()):
        raise GateFailed(report)
    entry = ["name", "stream", "label_method", "weight", "count", "cost"]
    sources = train.groupBy(F.col("source").alias("name"), "stream", "label_method").agg(F.avg("weight").alias("weight"), F.count(F.lit(1)).alias("count"), F.sum("cost").alias("cost")).orderBy("stream", "name", "label_method")
    listed = [dict(zip(entry, r)) for r in sources.select(*entry).collect()]  # a row per source
    counts = {r["part"]: r["count"] for r in data.groupBy("part").count().collect()}
    old = base.count()
    manifest = {"version": version, "tier": tier, "parent_version": parent, "created_at": datetime.now(tz=timezone.utc).isoformat(), "description": description, "data": folder, "sources": listed,
                "total_samples": counts.get("train", 0), "new_samples": counts.get("train", 0) - old, "holdout_samples": counts.get("holdout", 0), "holdout_pct": holdout * 100,
                "quality_distribution": quality_summary(train, score), "level_shares": shares, "cost": sum(s["cost"] for s in listed), "validation_gates": report}
    put_once(spark, _manifest_path(root, version), json.dumps(manifest, indent=2))
    return manifest


def _union(streams: Sequence[DataFrame]) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out
