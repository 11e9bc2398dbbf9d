"""Semi-structured records: layouts of ten-bin predictions, response texts, ids and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bins import bins_to_levels
from ..functions.numerics import clip, dbl

# Other names of the colour dimension.
DIMENSION_ALIASES = {"color_fidelity": "color", "colour": "color", "colour_fidelity": "color"}

BIN_RECORD = ("image string, model string, dimension string, probs array<double>, "
              + ", ".join(f"{d} struct<score: double, probs: array<double>>"
                          for d in ("overall", "sharpness", "color", "color_fidelity")))


def canonical_dimension(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in DIMENSION_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), name)


def _bin_records(lines: DataFrame) -> DataFrame:
    """Parsed lines with ``_rows``: dimension and bins of each, empty where a record has neither or no image."""
    rec = lines.select(F.from_json("line", BIN_RECORD).alias("r")).select("r.*")
    entry = lambda name, bins: F.struct(F.lit(name).alias("dimension"), bins.alias("bins"))
    wide = F.filter(F.array(entry("overall", F.col("overall.probs")), entry("sharpness", F.col("sharpness.probs")),
                            entry("color", F.coalesce("color_fidelity.probs", "color.probs"))),
                    lambda e: e["bins"].isNotNull())
    flat = F.array(F.struct(canonical_dimension(F.coalesce("dimension", F.lit("overall"))).alias("dimension"),
                            F.col("probs").alias("bins")))
    none = F.slice(flat, 1, 0)
    named = F.coalesce("image", F.lit("")) != ""
    rows = F.when(named & (F.size(wide) > 0), wide).when(named & F.col("probs").isNotNull(), flat).otherwise(none)
    return rec.withColumn("_rows", rows)


def bin_records_to_levels(lines: DataFrame) -> DataFrame:
    """One row per image and dimension with five-level probabilities ``p``.

    The many-dimension layout is used where any dimension carries bins, else the
    flat one. Records with neither, or without an image, give no row.
    """
    # not inline(): the filter on empty records that it infers goes below, and reads every line a dozen times more
    rows = _bin_records(lines).select("image", "model", F.inline_outer("_rows")).where("bins is not null")
    return rows.select("image", "model", "dimension", bins_to_levels(F.col("bins")).alias("p"))


def bin_record_counts(lines: DataFrame) -> DataFrame:
    """records, rows and skipped (records that give no row) per model."""
    n = F.size("_rows")
    return _bin_records(lines).groupBy("model").agg(F.count(F.lit(1)).alias("records"), F.sum(n).cast("long").alias("rows"), F.count(F.when(n == 0, 1)).alias("skipped"))


def canonical_id(path: Column, strict: bool = False) -> Column:
    """Last run of three or more digits that ends the file stem, else the first such
    run; NULL (or a failed job when ``strict``) where there is none."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    found = F.coalesce(F.nullif(F.regexp_extract(stem, r"(\d{3,})$", 1), F.lit("")),
                       F.nullif(F.regexp_extract(stem, r"(\d{3,})", 1), F.lit("")))
    if strict:
        return F.coalesce(found, F.raise_error(F.concat(F.lit("no id in "), path)).cast("string"))
    return found


def split_from_path(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("train"), "train").when(low.contains("test"), "test").when(low.contains("val"), "val")


def sibling_path(path: Column) -> Column:
    """Original next to a restored image; NULL where the path names neither."""
    return F.nullif(F.replace(F.replace(path, F.lit("/res/"), F.lit("/ori/")), F.lit("_res_"), F.lit("_ori_")), path)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def flexible_scores(record: Column, names=("overall", "sharpness", "color_fidelity")) -> list[Column]:
    """Scores from JSON text whose fields are numbers or objects with a ``score``."""
    return [F.coalesce(F.get_json_object(record, f"$.{n}.score").try_cast("double"),
                       F.get_json_object(record, f"$.{n}").try_cast("double")).alias(n) for n in names]


def unfenced(text: Column) -> Column:
    """Response text without code-fence lines and with doubled braces undone."""
    bare = F.trim(text)
    lines = F.filter(F.split(bare, "\n"), lambda l: ~F.ltrim(l).startswith("```"))
    bare = F.when(bare.startswith("```"), F.array_join(lines, "\n")).otherwise(bare)
    return F.replace(F.replace(bare, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def parse_rating(df: DataFrame, text: str, keys=("overall", "sharpness", "color_fidelity"),
                 low: float = 1.0, high: float = 5.0) -> DataFrame:
    """Scores of a rating response plus an ``error`` text, empty when every key is good."""
    parsed = df.withColumn("_m", F.from_json(unfenced(F.col(text)), "map<string,string>"))
    value = {k: F.try_element_at("_m", F.lit(k)).try_cast("double") for k in keys}
    error = F.when(F.col("_m").isNull(), "no JSON object in response")
    for k in keys:
        error = (error.when(~F.map_contains_key("_m", k), f"missing key {k}").when(value[k].isNull(), f"{k} is not a number")
                 .when((value[k] < low) | (value[k] > high), F.concat(F.lit(f"{k} score "), value[k].cast("string"), F.lit(f" outside [{low}, {high}]"))))
    parsed = parsed.withColumn("error", F.coalesce(error, F.lit("")))
    return parsed.select(*df.columns, *[F.when(F.col("error") == "", v).alias(k) for k, v in value.items()], "error")


def level_word(text: Column) -> Column:
    """Level name that opens a short answer, matched as a whole word."""
    low = F.regexp_replace(F.lower(F.trim(text)), r"\.+$", "")
    return F.nullif(F.regexp_extract(low, r"^(excellent|good|fair|poor|bad)\b", 1), F.lit(""))


def ten_to_five(score: Column) -> Column:
    return (score - 1) / dbl(9) * dbl(4) + dbl(1)


def quality_to_mos(quality: Column) -> Column:
    return dbl(1) + dbl(4) * clip(quality, 0, 1)


# Lower bounds of the quality buckets bad, poor, fair, good, excellent; the last ends at 5.01.
BUCKETS = (("bad", 1.0), ("poor", 1.8), ("fair", 2.6), ("good", 3.4), ("excellent", 4.0))


def quality_bucket(score: Column) -> Column:
    """Bucket index 0..4; anything outside [1, 5.01) counts as excellent."""
    edges = [lo for _, lo in BUCKETS][1:]
    inside = F.when(score < 1.0, 4)
    for i, hi in enumerate(edges):
        inside = inside.when(score < hi, i)
    return inside.otherwise(4)


def equal_width_level(mos: Column, low: Column, high: Column) -> Column:
    """Level 1..5 of equal width between two ends, widened by 1e-8; the lower level wins on an edge."""
    level = F.when(mos <= low + (high - low) * dbl(0.2) + 1e-8, 1)
    for i in (2, 3, 4):
        level = level.when(mos <= low + dbl(i / 5) * (high - low) + 1e-8, i)
    return level.otherwise(5)
