"""The row-local operators over streams: rating logs and incoming predictions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.numerics import key_hash
from ..operators.joins import fold_records, merge_records
from ..operators.records import parse_rating
from ..operators.uncertainty import Thresholds, decide
from ..operators.versions import put_once, read_text, names_in


def rating_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of an append-only log as they arrive."""
    return spark.readStream.schema(schema).json(path)


def parsed_stream(responses: DataFrame, text: str) -> DataFrame:
    """Scores and error text of streamed rating answers."""
    return parse_rating(responses, text)


def decided_stream(signals: DataFrame, limits: Thresholds | None = None) -> DataFrame:
    """Tier, weight and reason of streamed signal rows; the same CASE as in batch."""
    return decide(signals, limits)


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Append to Parquet; the checkpoint makes a restart continue where it stopped."""
    return (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def upsert_batches(updates: DataFrame, read_master, write_master, checkpoint: str, order: str):
    """Merge every micro-batch of partial records into the master table.

    Several updates of one id in a batch are folded by ``order`` first. ``read_master(ids)``
    returns the current records that can have these ids (a table in id buckets: the
    touched buckets) and ``write_master(df)`` stores their next version elsewhere, so a
    failed batch can be repeated and the rest of the table stays as it is.
    """
    def merge(batch: DataFrame, _: int) -> None:
        folded = fold_records(batch, order).persist()
        write_master(merge_records(read_master(folded.select("canonical_id")), folded))
        folded.unpersist()

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Master:
    """Image records in id buckets, stored in numbered versions.

    A version is a small file that names the folder of every bucket. A batch writes the
    buckets it touches to a folder of its own and then puts its version in place at once; the
    other buckets stay where they are. Readers take the newest version. Old folders may be
    removed once no reader needs them.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, buckets: int):
        self.spark, self.root, self.schema, self.buckets = spark, root.rstrip("/"), schema, buckets

    def version(self) -> tuple[int, dict[str, str]]:
        """Number of the newest batch (-1 before the first) and its folders by bucket."""
        numbers = [int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.root}/versions") if n.endswith(".json")]
        if not numbers:
            return -1, {}
        newest = max(numbers)
        return newest, json.loads(read_text(self.spark, f"{self.root}/versions/{newest}.json"))["folders"]

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        return self._read(list(self.version()[1].values()))

    def merge(self, updates: DataFrame, batch: int, order: str) -> bool:
        """Upsert one batch of partial records; False if the batch is in the master already."""
        number, folders = self.version()
        if batch <= number:
            return False
        bucket = (key_hash("bucket", F.col("canonical_id")) % self.buckets).cast("int")
        folder = f"{self.root}/data/{batch}-{uuid.uuid4().hex}"
        fold_records(updates, order).withColumn("_bucket", bucket).write.parquet(f"{folder}-updates")  # read twice from here
        folded = self.spark.read.parquet(f"{folder}-updates")
        touched = [str(r["_bucket"]) for r in folded.select("_bucket").distinct().collect()]  # a row per bucket
        held = self._read([folders[b] for b in touched if b in folders])
        merged = merge_records(held, folded.drop("_bucket")).select(*self.schema.names)
        merged.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(folder)
        now = {**folders, **{b: f"{folder}/_bucket={b}" for b in touched}}
        put_once(self.spark, f"{self.root}/versions/{batch}.json", json.dumps({"batch": batch, "folders": now}))
        return True


def upsert_stream(updates: DataFrame, master: Master, checkpoint: str, order: str):
    """Keep ``master`` up to date with streamed partial records. A batch that failed anywhere is
    run again whole; one that had been put in place is skipped."""
    def run(batch: DataFrame, number: int) -> None:
        master.merge(batch, number, order)

    return updates.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
