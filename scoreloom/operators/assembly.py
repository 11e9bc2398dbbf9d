"""Sampling, splits and training tables.

Random choices are ranks of a key hash, so they repeat under any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import levels as lv
from ..functions.numerics import dbl, key_hash
from .ranking import attach, attach_one, hash_position, position
from .records import equal_width_level

# Question texts and answer forms of the training records.
QUESTIONS = (
    "What do you think about the quality of this image?",
    "Can you rate the quality of this picture?",
    "Can you judge the quality of this image?",
    "How would you rate the quality of this image?",
    "How would you judge the quality of this image?",
    "What is your quality rating for this image?",
    "What's your opinion on the quality of this picture?",
    "Rate the quality of this image.",
    "Could you evaluate the quality of this image?",
    "How do you assess the quality of this image?",
)
# Answers per dimension; {} is the level.
ANSWERS = {
    "overall": "The quality of the image is {}.",
    "sharpness": "The sharpness of the image is {}.",
    "color": "The color_fidelity of the image is {}.",
}
# Share of rows per degradation tier.
TIER_SHARES = {"pristine": 0.10, "light": 0.25, "moderate": 0.35, "heavy": 0.20, "historical": 0.10}
# Tier label, profile name, expected quality range.
DEGRADATIONS = (("HIGH", "light", 0.70, 0.95), ("MEDIUM", "moderate", 0.40, 0.80), ("LOW", "heavy", 0.10, 0.60), ("DEGRADED", "historical", 0.00, 0.50))
EFFECTS = ("blur", "noise", "compression", "geometric_distortion")


# ---- text of records -------------------------------------------------------------

def question(seed, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (key_hash(seed, key) % len(QUESTIONS) + 1).cast("int"))


def answer(dimension: Column, probs: Column) -> Column:
    """Sentence naming the most likely level; unknown dimensions read like ``overall``."""
    sentence = F.lit(ANSWERS["overall"])
    for name, text in ANSWERS.items():
        sentence = F.when(dimension == name, text).otherwise(sentence)
    return F.replace(sentence, F.lit("{}"), lv.level_text(probs))


def conversation(ask: Column, reply: Column) -> Column:
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    return F.array(turn("human", F.concat(ask, F.lit("\n<|image|>"))), turn("gpt", reply))


def training_record(df: DataFrame, id_prefix: str, pseudo: bool, image_prefix: str = "", seed=42) -> DataFrame:
    """Training layout from rows with image_id, dimension, probs, weight and tier."""
    image = F.col("image_id").cast("string")
    if image_prefix:
        image = F.when(image.startswith(image_prefix), image).otherwise(F.concat(F.lit(f"{image_prefix}/"), image))
    tidy = F.transform("probs", lambda v: F.round(v, 6))
    score, spread = F.round(lv.mos(F.col("probs")), 4), F.round(lv.std(F.col("probs")), 4)
    return df.select(
        F.concat_ws("_", F.lit(id_prefix), "dimension", F.col("image_id").cast("string")).alias("id") if id_prefix
        else F.concat_ws("_", "dimension", F.col("image_id").cast("string")).alias("id"),
        image.alias("image"), score.alias("gt_score"), score.alias("gt_score_norm"), tidy.alias("level_probs"),
        conversation(question(seed, F.col("image_id")), answer(F.col("dimension"), tidy)).alias("conversations"),
        spread.alias("std"), spread.alias("std_norm"), F.lit(pseudo).alias("pseudo_label"),
        F.round("weight", 4).alias("confidence_weight"), F.col("tier").alias("source_tier"))


# ---- splits and samples ------------------------------------------------------------

def holdout_split(df: DataFrame, key: str, source: str = "source", share: float = 0.10, seed=42) -> DataFrame:
    """Add ``part``: per source max(1, int(n * share)) rows are held out."""
    placed = hash_position(df, seed, key, [source], "_p", size="_n")
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * dbl(share)))
    return placed.withColumn("part", F.when(F.col("_p") <= quota, "holdout").otherwise("train")).drop("_p", "_n")


def per_bucket(df: DataFrame, bucket: str, key: str, n: int, seed=42, exclude: DataFrame | None = None) -> DataFrame:
    """Up to ``n`` random rows of every bucket, without the excluded keys."""
    if exclude is not None:
        df = df.join(exclude.select(key), key, "left_anti")
    return hash_position(df, seed, key, [bucket], "_p").where(F.col("_p") <= n).drop("_p")


def select_bases(df: DataFrame, score: str, key: str, n: int, strategy: str = "stride", seed=42) -> DataFrame:
    """Base rows: evenly spaced by key, highest scores, or the same number per score bin with top-up."""
    if strategy == "stride":
        placed = position(df, key, key, (), "_p", size="_n")
        stride = F.greatest(F.lit(1), F.floor(F.col("_n") / F.least(F.lit(n), F.col("_n"))))
        return placed.where(((F.col("_p") - 1) % stride == 0) & ((F.col("_p") - 1) / stride < n)).drop("_p", "_n")
    if strategy == "highest_quality":
        return position(df, score, key, (), "_p", descending=True).where(F.col("_p") <= n).drop("_p")
    if strategy != "stratified":
        raise ValueError(f"unknown strategy {strategy}")
    binned = df.withColumn("_bin", F.least(F.floor(F.col(score) - 1), F.lit(3)))
    placed = hash_position(binned, seed, key, ["_bin"], "_p")
    quota = n // 4
    taken = placed.agg(F.count(F.when(F.col("_p") <= quota, 1)).alias("_taken"))
    # The remainder goes round the bins: next row of bin 0, of bin 1, ... so it orders by (row, bin).
    rest = position(placed.where(F.col("_p") > quota).withColumn("_turn", F.col("_p") * 4 + F.col("_bin")), "_turn", key, (), "_rp")
    rest = attach_one(rest, taken).where(F.col("_rp") <= n - F.col("_taken"))
    return placed.where(F.col("_p") <= quota).select(*df.columns).unionByName(rest.select(*df.columns))


def plan_tiers(df: DataFrame, key: str, shares: dict[str, float] = TIER_SHARES, filler: str = "moderate", seed=42) -> DataFrame:
    """Assign tiers in the given shares by random position; rounding leftovers get the filler."""
    placed = hash_position(df, seed, key, (), "_p", size="_n")
    end, tier = F.lit(0), None
    for name, share in shares.items():
        end = end + F.bround(F.col("_n") * dbl(share), 0)
        tier = F.when(F.col("_p") <= end, name) if tier is None else tier.when(F.col("_p") <= end, name)
    return placed.withColumn("tier", tier.otherwise(filler)).drop("_p", "_n")


def resample_exact(df: DataFrame, key: str, target: Column, seed=42, max_rows: int | None = None) -> DataFrame:
    """Exactly ``target`` rows (a function of ``n``): every row once, then random
    repeats; fewer if the target is smaller. Each row makes its own extra slots."""
    placed = hash_position(df, seed, key, (), "_p", size="n").withColumn("_t", target.cast("long"))
    slots = F.sequence(F.col("_p"), F.greatest(F.col("_t"), F.col("_p")), F.col("n"))
    spread = placed.select("_p", "n", "_t", F.explode(slots).alias("slot")).where(F.col("slot") <= F.col("_t"))
    pick = F.when(F.col("slot") <= F.col("n"), F.col("slot")).otherwise(key_hash(seed, F.col("slot")) % F.col("n") + 1)
    chosen = spread.select("slot", pick.alias("_p"))
    if max_rows is not None:
        chosen = chosen.where(F.col("slot") <= max_rows)
    return chosen.join(placed.drop("n", "_t"), "_p").drop("_p")


def repeat_rows(df: DataFrame, times: Column) -> DataFrame:
    """Integer weights as repeated rows, with the number of the copy."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).where(times >= 1)


def mix(truth: DataFrame, pseudo: DataFrame, min_confidence: float = 0.0, truth_weight: float = 1.0, pseudo_weight: float = 0.5) -> DataFrame:
    """Human and machine rows with sampling weight; machine rows below the confidence limit dropped."""
    kept = pseudo.where(F.coalesce("confidence", dbl(1)) >= min_confidence)
    a = truth.withColumns({"origin": F.lit("truth"), "sample_weight": dbl(truth_weight)})
    return a.unionByName(kept.withColumns({"origin": F.lit("pseudo"), "sample_weight": dbl(pseudo_weight)}), allowMissingColumns=True)


def rows_of_epoch(mixed: DataFrame, epoch: int, strategy: str = "interleave") -> DataFrame:
    """All rows, or human rows on even and machine rows on odd epochs."""
    if strategy == "epoch_alternate":
        return mixed.where(F.col("origin") == ("truth" if epoch % 2 == 0 else "pseudo"))
    return mixed


def quota_sample(df: DataFrame, source: str, key: str, quotas: dict[str, int], seed=42) -> DataFrame:
    """Random rows of two sources; what one lacks is taken from the other."""
    (a, na), (b, nb) = quotas.items()
    sizes = df.agg(F.count(F.when(F.col(source) == a, 1)).alias("_na"), F.count(F.when(F.col(source) == b, 1)).alias("_nb"))
    total = na + nb
    got_a, got_b = F.least(F.lit(na), F.col("_na")), F.least(F.lit(nb), F.col("_nb"))
    take_b = F.when(got_a < na, F.least(total - got_a, F.col("_nb"))).otherwise(got_b)
    take_a = F.when((got_a >= na) & (got_b < nb), F.least(total - got_b, F.col("_na"))).otherwise(got_a)
    placed = attach_one(hash_position(df.where(F.col(source).isin(a, b)), seed, key, [source], "_p"), sizes)
    return placed.where(F.col("_p") <= F.when(F.col(source) == a, take_a).otherwise(take_b)).select(*df.columns)


# ---- annotation ------------------------------------------------------------------------

def pick_anchors(df: DataFrame, score: str, spread: str, key: str, targets=(1.0, 2.0, 3.0, 4.0, 5.0), tolerance: float = 0.3) -> DataFrame:
    """One row per target score: among rows within the tolerance (else the 20 nearest)
    the smallest mean of scaled spread and scaled distance."""
    parts = []
    for target in targets:
        near = df.withColumn("_d", F.abs(F.col(score) - dbl(target)))
        found = near.agg(F.count(F.when(F.col("_d") <= tolerance, 1)).alias("_found"))
        inside = near.where(F.col("_d") <= tolerance)
        nearest = attach_one(near.orderBy("_d", key).limit(20), found).where(F.col("_found") == 0).drop("_found")
        pool = inside.unionByName(nearest)
        ends = pool.agg(F.max(spread).alias("_s"), F.greatest(F.max("_d"), dbl(1e-8)).alias("_m"))
        merit = F.round(F.col(spread) / F.col("_s") * dbl(0.5) + F.col("_d") / F.col("_m") * dbl(0.5), 9)
        best = attach_one(pool, ends).agg(F.min_by(F.struct(*df.columns), F.struct(merit, F.col(key))).alias("_r"))
        parts.append(best.where(F.col("_r").isNotNull()).select(dbl(target).alias("target"), "_r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STRATA = ((0, 5, "low_spread_sanity_check"), (1, 10, "medium_spread_boundary"), (2, 10, "high_spread_diagnostic"))


def stratified_pick(df: DataFrame, spread: str, label: str, category: str, key: str, strata=STRATA, batch: int = 25) -> DataFrame:
    """Rows for annotation: a number per class, split over categories and evenly
    spaced over the spread inside each; empty classes borrow from their neighbours."""
    parts = []
    for value, want, name in strata:
        own = df.where(F.col(label) == value)
        n_own = own.agg(F.count(F.lit(1)).alias("_own"))
        if value == 1:
            ranked = position(df, spread, key, (), "_q", size="_all")
            lend = ranked.where((F.col("_q") > F.floor(F.col("_all") / 3)) & (F.col("_q") <= F.floor(2 * F.col("_all") / 3))).drop("_q", "_all")
        else:
            lend = df.orderBy(F.col(spread).desc() if value == 2 else F.col(spread), key).limit(want * 3)
        lent = attach_one(lend, n_own).where(F.col("_own") == 0).drop("_own")
        pool = own.unionByName(lent)
        facts = pool.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(category).alias("_cats"))
        placed = attach_one(position(pool, spread, key, [category], "_p", size="_c"), facts)
        n_select = F.least(F.lit(want), F.col("_n"))
        k = F.least(F.greatest(F.lit(1), F.floor(n_select / F.col("_cats"))), F.col("_c"))
        chosen = F.exists(F.sequence(F.lit(0).cast("long"), k - 1),
                          lambda i: F.floor(F.when(k > 1, i * (F.col("_c") - 1) / (k - 1)).otherwise(0)) == F.col("_p") - 1)
        picked = placed.where(chosen)
        # At most one row per category and want rows in all from here on.
        order = Window.partitionBy(F.lit(0)).orderBy(category, "_p")
        picked = picked.withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= want)
        parts.append(picked.select(*df.columns, F.lit(name).alias("annotation_stratum"), F.lit(value).alias("_stratum"), "_o"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = Window.partitionBy(F.lit(0)).orderBy("_stratum", "_o")
    return out.withColumn("_t", F.row_number().over(total)).where(F.col("_t") <= batch).drop("_t", "_o", "_stratum")


def annotation_batch(picks: DataFrame, anchors: DataFrame, key: str, seed=42) -> DataFrame:
    """Picks and anchors in random order with empty rating columns (a few dozen rows)."""
    none = F.lit(None).cast("double")
    a = picks.select(key, F.lit(False).alias("is_anchor"), "annotation_stratum", F.col("spread").alias("model_spread"), none.alias("known_mos"))
    b = anchors.select(key, F.lit(True).alias("is_anchor"), F.lit("anchor").alias("annotation_stratum"), F.col("spread").alias("model_spread"), F.col("mos").alias("known_mos"))
    order = Window.partitionBy(F.lit(0)).orderBy(key_hash(seed, F.col(key), F.col("is_anchor").cast("string")), key)
    both = a.unionByName(b).withColumn("presentation_order", F.row_number().over(order))
    return both.withColumns({f"rater_score_{d}": none for d in ("overall", "sharpness", "color_fidelity")})


def process_raters(ratings: DataFrame, anchors: DataFrame, outlier_std: float = 2.0, high_std: float = 1.0) -> DataFrame:
    """Mean score per image and dimension from reliable raters, rescaled by anchors.

    ``ratings``: image_id, dimension, rater, score. ``anchors``: image_id,
    dimension, known_mos. A rater whose anchor residuals vary by more than
    ``outlier_std`` in any dimension (with three or more anchors) is dropped. The
    spread is compared with ``high_std`` to nine digits, so that a spread of just
    that limit never counts as above it, whatever the order of its sum.
    """
    keys = ["image_id", "dimension"]
    residual = ratings.join(anchors, keys).groupBy("rater", "dimension").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col("score") - F.col("known_mos")).alias("sd"))
    dropped = residual.where((F.col("n") >= 3) & (F.col("sd") > outlier_std)).select("rater").distinct()
    kept = ratings.join(dropped, "rater", "left_anti")
    mos = kept.groupBy(*keys).agg(F.avg("score").alias("mos"), F.stddev_samp("score").alias("mos_std"))
    line = mos.join(anchors, keys).groupBy("dimension").agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope("known_mos", "mos").alias("_a"), F.regr_intercept("known_mos", "mos").alias("_b"))
    joined = attach(mos, line, ["dimension"], "left")
    calibrated = F.when(F.col("_n") >= 2, F.col("mos") * F.col("_a") + F.col("_b"))
    return joined.select(*keys, "mos", "mos_std", calibrated.alias("calibrated"), F.coalesce(F.round("mos_std", 9) > high_std, F.lit(False)).alias("high_variance"))


# ---- plans and labels -------------------------------------------------------------------

def degradation_plan(bases: DataFrame, index: str, base_seed: int = 20000) -> DataFrame:
    """Every base under every tier: tier, profile, seed, the tier's expected range of quality, a severity
    of each effect drawn from that range by key hash, and ``overall_quality``, 1 - worst."""
    tiers = F.inline(F.array(*[F.struct(F.lit(i).alias("tier_index"), F.lit(label).alias("tier"), F.lit(name).alias("profile"), dbl(lo).alias("quality_low"), dbl(hi).alias("quality_high"))
                               for i, (label, name, lo, hi) in enumerate(DEGRADATIONS)]))
    rows = bases.select("*", tiers).withColumn("seed", base_seed + F.col(index) * 100 + F.col("tier_index"))
    unit = lambda effect: (key_hash(effect, F.col("seed")) % 1000000) / dbl(1000000)
    rows = rows.withColumns({e: (dbl(1) - F.col("quality_high")) + unit(e) * (F.col("quality_high") - F.col("quality_low")) for e in EFFECTS})
    return rows.withColumn("overall_quality", F.greatest(dbl(0), dbl(1) - F.greatest(*EFFECTS)))


def soft_labels(df: DataFrame, mos: str, std: str, density: str = "pdf", std_limit: float = 0.2, gap_limit: float = 0.1) -> DataFrame:
    """Level distribution from a mean and a spread, both rescaled by the observed range.

    Density or mass per level, a linear fix so that the mean is kept, and the
    two-level form where the spread is small or the fixed mean is off.
    """
    ends = df.agg(F.min(mos).alias("_lo"), F.max(mos).alias("_hi"))
    c = F.col
    rows = attach_one(df, ends).withColumn("mos_norm", 4 * (c(mos) - c("_lo")) / (c("_hi") - c("_lo")) + 1).withColumn("std_norm", 4 * c(std) / (c("_hi") - c("_lo")))
    if density == "cdf":
        from ..functions.numerics import normal_cdf

        raw = F.transform(lv.constants(lv.LEVEL_SCORES), lambda v: normal_cdf((v + 0.5 - c("mos_norm")) / c("std_norm")) - normal_cdf((v - 0.5 - c("mos_norm")) / c("std_norm")))
    else:
        norm = dbl((2 * 3.141592653589793) ** 0.5)
        raw = F.transform(lv.constants(lv.LEVEL_SCORES), lambda v: F.exp(-((v - c("mos_norm")) / c("std_norm")) * ((v - c("mos_norm")) / c("std_norm")) / 2) / (c("std_norm") * norm))
    rows = rows.withColumn("probs_org", raw).withColumn("_fix", lv.linear_fix(c("probs_org"), c("mos_norm")))
    rows = rows.withColumn("_fixed", F.transform("probs_org", lambda v: F.greatest(v * c("_fix.alpha") + c("_fix.beta"), dbl(0))))
    rows = rows.withColumn("is_two_level", (c("std_norm") < std_limit) | (F.abs(lv.mos(c("_fixed")) - c("mos_norm")) > gap_limit))
    probs = F.when(c("is_two_level"), lv.two_level_padded(c("mos_norm"))).otherwise(c("_fixed"))
    rows = rows.withColumn("probs", probs)
    return rows.withColumns({
        "raw_gap": F.abs(lv.mos(c("probs_org")) - c("mos_norm")), "gap": F.abs(lv.mos(c("probs")) - c("mos_norm")),
        "alpha": F.when(c("is_two_level"), dbl(1)).otherwise(c("_fix.alpha")), "beta": F.when(c("is_two_level"), dbl(0)).otherwise(c("_fix.beta")),
    }).drop("_fix", "_fixed", "_lo", "_hi")


def soft_label_records(soft: DataFrame, image: str, mos: str, std: str, mos_text: str, split: str = "split", seed=42) -> DataFrame:
    """Records of the rows of ``soft_labels`` whose split is train or test, by ``split``.

    Training records have both level distributions and a conversation that names the fifth of the
    range the mean lies in; those of test rows are NULL. Rows of other splits give none.
    """
    c, train = F.col, F.col(split) == "train"
    level = F.element_at(F.array(*[F.lit(n) for n in reversed(lv.LEVEL_NAMES)]), equal_width_level(c("mos_norm"), dbl(1), dbl(5)))
    reply = F.replace(F.lit(ANSWERS["overall"]), F.lit("{}"), level)
    taught = lambda x: F.when(train, x)
    return soft.where(c(split).isin("train", "test")).select(
        split, F.concat(F.element_at(F.split(image, "/"), -1), F.lit("->"), c(mos_text)).alias("id"), c(image).alias("image"), c(mos).alias("gt_score"), c("mos_norm").alias("gt_score_norm"),
        taught(c("probs_org")).alias("level_probs_org"), taught(c("probs")).alias("level_probs"), c(std).alias("std"), "std_norm",
        taught(conversation(question(seed, c(image)), reply)).alias("conversations"))


def soft_label_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c = F.col
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("raw_gap").alias("raw_l1"), F.sqrt(F.avg(c("raw_gap") * c("raw_gap"))).alias("raw_l2"), F.avg("gap").alias("l1"),
        F.sqrt(F.avg(c("gap") * c("gap"))).alias("l2"), F.avg("alpha").alias("alpha_mean"), F.stddev_pop("alpha").alias("alpha_std"),
        F.avg("beta").alias("beta_mean"), F.stddev_pop("beta").alias("beta_std"), F.avg(c("is_two_level").cast("int")).alias("two_level_share"))


def random_partner(df: DataFrame, key: str, group: str, seed=42) -> DataFrame:
    """A random other row of the same group for every row (none in groups of one).

    Rows are numbered inside their group and partners met by number, so a big
    group is spread over its numbers, never collected.
    """
    placed = position(df, key, key, [group], "_i", size="_n").where(F.col("_n") > 1)
    offset = key_hash(seed, F.col(key)) % (F.col("_n") - 1) + 1
    asked = placed.withColumn("_j", (F.col("_i") - 1 + offset) % F.col("_n") + 1)
    other = placed.select(group, F.col("_i").alias("_j"), F.col(key).alias("partner"))
    return asked.join(other, [group, "_j"]).select(*df.columns, "partner")
