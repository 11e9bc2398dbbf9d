"""Readers for JSON lines, JSON arrays, CSV and Parquet inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

LINE_ORDER = ["_file", "_block", "_line_id"]


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank lines are skipped, files are split across tasks."""
    return spark.read.schema(schema).json(path)


def with_line_order(df: DataFrame) -> DataFrame:
    """Add columns that sort like (file, line): a split reads its lines in order."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_line_id"))


def read_last_per_key(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """JSON lines where the last line of a key wins; partial maxima are taken before the shuffle."""
    rows = with_line_order(read_jsonl(spark, path, schema))
    names = [c for c in rows.columns if c not in (*keys, *LINE_ORDER)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*LINE_ORDER)).alias("_r"))
    return last.select(*keys, "_r.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last row of each key by an explicit order column."""
    names = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col(order)).alias("_r")).select(*keys, "_r.*")


def read_dimension_arrays(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """One file set of JSON arrays per dimension; the dimension comes from the mapping."""
    out = None
    for dimension, path in paths.items():
        part = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("dimension", F.lit(dimension))
        out = part if out is None else out.unionByName(part)
    return out


def read_grades_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="res string, ori string, overall double, sharpness double, color_fidelity double", enforceSchema=False)


def read_ratings_by_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rating logs of many models; the model id is the file name, with ``__`` for a slash."""
    rows = read_jsonl(spark, path, schema).select("*", F.col("_metadata.file_path").alias("_file"))
    name = F.regexp_extract(F.url_decode("_file"), r"([^/=]+)\.jsonl", 1)
    return rows.withColumn("model_id", F.regexp_replace(name, "__", "/")).drop("_file")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on the first line that does not fit the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_quarantined(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad lines with their file and line number.

    Lines are numbered per file split and shifted by the lines of the earlier
    splits, so no file passes through one task.
    """
    lines = with_line_order(spark.read.text(path))
    split = Window.partitionBy("_file", "_block").orderBy("_line_id")
    counts = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    files = Window.partitionBy("_file").orderBy("_block")  # one row per split
    offsets = counts.select("_file", "_block", (F.sum("_n").over(files) - F.col("_n")).alias("_before"))
    numbered = lines.withColumn("_at", F.row_number().over(split)).join(offsets, ["_file", "_block"]).select(
        F.col("_file").alias("file"), (F.col("_before") + F.col("_at")).alias("line_number"), F.col("value").alias("line"))
    parsed = numbered.where(F.trim("line") != "").withColumn(
        "r", F.from_json("line", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select("file", "line_number", "line")
