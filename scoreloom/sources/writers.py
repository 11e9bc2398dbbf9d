"""Writers and record checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.numerics import total


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, ``overwrite`` or ``append``."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode}")
    df.write.mode(mode).json(path)


def write_per_dimension(df: DataFrame, path: str) -> None:
    """One folder per dimension."""
    df.write.mode("overwrite").partitionBy("dimension").json(path)


def record_problems(probs: Column, gt_score: Column, std: Column, weight: Column, category: Column) -> Column:
    """Names of the rules a record breaks; an empty array for a good one. NULL optional fields pass."""
    outside = lambda c, lo, hi: c.isNotNull() & ((c < lo) | (c > hi))
    rules = [("level_probs length", probs.isNull() | (F.size(probs) != 5)), ("level_probs sum", F.abs(total(probs) - 1) > 0.01),
             ("gt_score range", outside(gt_score, 0, 5)), ("std range", std.isNotNull() & (std < 0)),
             ("weight range", outside(weight, 0, 1)), ("category range", outside(category, 0, 2))]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


RECORD = "image_id bigint, level_probs array<double>, gt_score double, std double, confidence_weight double, ood_category int"


def checked_records(lines: DataFrame, line: str = "line", record: str = RECORD) -> tuple[DataFrame, DataFrame]:
    """JSON lines as two tables: records that keep every rule, typed, and the others as they came with ``problems``.

    A line that is no object, a field that the record does not know and every broken rule is a
    problem; a line can have several. NULL and empty lines are no objects.
    """
    names = list(T._parse_datatype_string(record).fieldNames())
    keys = F.json_object_keys(line)
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(n) for n in names])))
    parsed = F.from_json(line, record)
    r = lambda n: F.col("_r")[n]
    rows = lines.withColumns({"_keys": keys, "_unknown": unknown, "_r": parsed})
    rules = record_problems(r("level_probs"), r("gt_score"), r("std"), r("confidence_weight"), r("ood_category"))
    stray = F.when(F.size("_unknown") > 0, F.array(F.concat(F.lit("unknown fields: "), F.array_join("_unknown", ", ")))).otherwise(F.array().cast("array<string>"))
    found = F.when(F.col("_keys").isNull(), F.array(F.lit("no record"))).otherwise(F.concat(stray, rules))
    rows = rows.withColumn("problems", found)
    valid = rows.where(F.size("problems") == 0).select("_r.*")
    return valid, rows.where(F.size("problems") > 0).select(*lines.columns, "problems")


def unknown_fields(df: DataFrame, allowed: list[str]) -> list[str]:
    """Columns a strict schema does not know."""
    return sorted(set(df.columns) - set(allowed))


def require_known_fields(df: DataFrame, allowed: list[str]) -> DataFrame:
    extra = unknown_fields(df, allowed)
    if extra:
        raise ValueError(f"unknown fields: {', '.join(extra)}")
    return df


def manifest(records: DataFrame, version: str, tier: str, parent: str | None = None) -> DataFrame:
    """One row describing a data set: totals and a list of sources with counts, weight and cost."""
    per_source = records.groupBy("stream", "source").agg(
        F.count(F.lit(1)).alias("count"), F.avg("confidence_weight").alias("mean_weight"), F.sum("cost").alias("cost"))
    entry = F.struct("stream", "source", "count", "mean_weight", "cost")
    # One entry per source of the data set.
    row = per_source.agg(F.sum("count").alias("total"), F.sum("cost").alias("total_cost"), F.array_sort(F.collect_list(entry)).alias("sources"))
    text = F.concat(F.lit(f"{version} ({tier}): "), F.col("total").cast("string"), F.lit(" records from "), F.size("sources").cast("string"), F.lit(" sources"))
    return row.select(F.lit(version).alias("version"), F.lit(tier).alias("tier"), F.lit(parent).cast("string").alias("parent"), "total", "total_cost", "sources", text.alias("summary"))
