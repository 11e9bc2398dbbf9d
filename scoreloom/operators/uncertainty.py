"""Signals, tiers and weights of machine-made labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import levels as lv
from ..functions.numerics import clip, dbl
from .ranking import attach, attach_one, position, quantiles, unit_ranks
from .staging import staged

KEYS = ["image_id", "dimension"]
AUTO, LOW, REVIEW, REJECT = "auto_accept", "low_weight", "tier2_trigger", "hard_reject"
TIERS = (AUTO, LOW, REVIEW, REJECT)


@dataclass(frozen=True)
class Thresholds:
    """Decision limits; ``jsd`` gives (auto, low) per dimension. Spread limits are off unless both are set."""

    distance_ood: float = 55.37
    distance_reject: float = 61.62
    sigma_sq_auto: float = 0.64
    sigma_sq_low: float = 1.0
    entropy_auto: float = 1.2
    entropy_low: float = 1.5
    jsd: dict[str, tuple[float, float]] = field(default_factory=dict)
    jsd_default: tuple[float, float] = (0.06, 0.12)
    spread_auto: float | None = None
    spread_low: float | None = None
    low_weight: tuple[float, float] = (0.3, 0.6)

    def columns(self) -> dict[str, Column]:
        def per_dimension(i):
            out = F.when(F.lit(False), dbl(0))
            for name, pair in self.jsd.items():
                out = out.when(F.col("dimension") == name, dbl(pair[i]))
            return out.otherwise(dbl(self.jsd_default[i]))

        simple = ("distance_ood", "distance_reject", "sigma_sq_auto", "sigma_sq_low", "entropy_auto", "entropy_low")
        out = {n: dbl(getattr(self, n)) for n in simple}
        out |= {"jsd_auto": per_dimension(0), "jsd_low": per_dimension(1)}
        if self.spread_auto is not None and self.spread_low is not None:
            out |= {"spread_auto": dbl(self.spread_auto), "spread_low": dbl(self.spread_low)}
        return out


# ---- signals -----------------------------------------------------------------

def cross_validate(preds: DataFrame, cross_levels: DataFrame) -> DataFrame:
    """Own and partner distribution, divergence, score gap, entropy; only rows with a partner."""
    sigma = lv.floored_sigma(F.col("sigma_sq"))
    joined = preds.join(cross_levels, KEYS).select(
        *KEYS, lv.clip(F.col("mu"), 1, 5).alias("mu"), "sigma_sq",
        lv.gaussian_levels(F.col("mu"), sigma).alias("own_probs"), "cross_probs")
    cross_mos = lv.mos(F.col("cross_probs"))
    return joined.select("*", cross_mos.alias("cross_mos"),
                         lv.jsd(F.col("own_probs"), F.col("cross_probs")).alias("jsd"),
                         F.abs(F.col("mu") - cross_mos).alias("mos_delta"),
                         lv.entropy(F.col("own_probs")).alias("entropy"))


def signals(preds: DataFrame, cross_levels: DataFrame, distances: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """One row per image and dimension with every signal.

    A missing partner counts as self-agreement: no divergence, entropy of the
    label itself. Distance and spread are per image and joined once.
    """
    usable = preds.where(F.col("mu").isNotNull() & F.col("sigma_sq").isNotNull())
    joined = usable.join(cross_levels, KEYS, "left").join(distances, "image_id")
    if spread is not None:
        joined = joined.join(spread.select("image_id", "spread", "cluster_divergence", "n_spread_models"), "image_id", "left")
    else:
        joined = joined.withColumns({"spread": dbl(0), "cluster_divergence": dbl(0), "n_spread_models": F.lit(0)})
    return with_signals(joined)


def with_signals(joined: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The signals of rows with mu, sigma_sq, distance, ``cross_probs`` (NULL without a partner) and spreads; columns of ``also`` stay."""
    has = F.col("cross_probs").isNotNull()
    labelled = joined.select(
        *KEYS, *also, "mu", "sigma_sq", "distance", F.coalesce("spread", dbl(0)).alias("spread"),
        F.coalesce("cluster_divergence", dbl(0)).alias("cluster_divergence"),
        F.coalesce("n_spread_models", F.lit(0)).cast("int").alias("n_spread_models"), "cross_probs",
        lv.prediction_levels(F.col("mu"), F.col("sigma_sq")).alias("probs"))
    own = labelled.withColumn("_own", F.when(has, lv.gaussian_levels(F.col("mu"), lv.floored_sigma(F.col("sigma_sq"))))
                              .otherwise(F.col("probs")))
    # Nine digits keep last-bit noise of logarithms out of threshold and rank comparisons.
    return own.select(
        *KEYS, *also, "mu", "sigma_sq", "distance", "spread", "cluster_divergence", "n_spread_models", "probs", "cross_probs",
        F.round(F.when(has, lv.jsd(F.col("_own"), F.col("cross_probs"))).otherwise(dbl(0)), 9).alias("jsd"),
        F.round(lv.entropy(F.col("_own")), 9).alias("entropy"),
        lv.mos(F.col("probs")).alias("mos"), lv.std(F.col("probs")).alias("std"))


# ---- decision -------------------------------------------------------------------

def decide(df: DataFrame, limits: Thresholds | dict[str, Column] | None = None, with_jsd: bool = True,
           with_reason: bool = True, low_weight=(0.3, 0.6)) -> DataFrame:
    """Add ``tier``, ``weight`` and ``reason``; one ordered CASE, nothing is shuffled.

    ``limits`` may be columns, so every row can carry its own profile.
    """
    limits = limits or Thresholds()
    if isinstance(limits, Thresholds):
        low_weight = limits.low_weight
        limits = limits.columns()
    c = F.col
    checks = [("sigma_sq", c("sigma_sq"), "σ²=%.3f"), ("entropy", c("entropy"), "H=%.3f")]
    if with_jsd:
        checks.insert(0, ("jsd", c("jsd"), "JSD=%.3f"))
    if "spread_auto" in limits:
        # Spread counts only where at least two raters scored the image.
        checks.append(("spread", F.when(c("n_spread_models") >= 2, c("spread")).otherwise(dbl("-inf")), "spread=%.3f"))
    all_within = lambda edge: _all([v <= limits[f"{n}_{edge}"] for n, v, _ in checks])
    reject, ood = c("distance") > limits["distance_reject"], c("distance") > limits["distance_ood"]
    tier = (F.when(reject, REJECT).when(ood, REVIEW).when(all_within("auto"), AUTO)
            .when(all_within("low"), LOW).otherwise(REVIEW))

    lo, hi = low_weight
    spots = []
    for n, v, _ in checks:
        width = limits[f"{n}_low"] - limits[f"{n}_auto"]
        spots.append(F.when(width > 0, clip((v - limits[f"{n}_auto"]) / F.when(width > 0, width), 0, 1)))
    worst = F.coalesce(F.greatest(*spots), dbl(0))
    scored = df.withColumn("tier", tier).withColumn(
        "weight", F.when(c("tier") == AUTO, dbl(1)).when(c("tier") == LOW, dbl(hi) - worst * dbl(hi - lo)).otherwise(dbl(0)))
    if not with_reason:
        return scored
    one = F.format_string("%.1f", F.bround("distance", 1))
    over = F.concat_ws(", ", *[F.when(v > limits[f"{n}_low"], F.format_string(text, F.bround(v, 3))) for n, v, text in checks])
    reason = (F.when(reject, F.concat(F.lit("d_M="), one, F.lit(" > "), limits["distance_reject"].cast("string"), F.lit(" (hard reject)")))
              .when(ood, F.concat(F.lit("d_M="), one, F.lit(" > "), limits["distance_ood"].cast("string"), F.lit(" (OOD)")))
              .when(c("tier") == AUTO, "All signals within auto-accept thresholds")
              .when(c("tier") == LOW, F.concat(F.lit("Signals within low-weight range (weight="),
                                               F.format_string("%.2f", F.bround("weight", 2)), F.lit(")")))
              .otherwise(F.concat(F.lit("Exceeded low-weight thresholds: "), over)))
    return scored.withColumn("reason", reason)


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def pseudo_labels(preds: DataFrame, cross_levels: DataFrame, distances: DataFrame, spread: DataFrame | None = None,
                  limits: Thresholds | None = None) -> DataFrame:
    """The whole single pass: signals, label, tier, weight and reason per image and dimension."""
    return decide(signals(preds, cross_levels, distances, spread), limits)


def review_queue(labelled: DataFrame, share: float = 0.10) -> DataFrame:
    """Rows waiting for a second opinion: highest divergence first, at most
    ``int(share * images)`` rows. Images are counted over the whole input."""
    pool = labelled.agg(F.count_distinct("image_id").alias("pool"))
    waiting = _keyed(labelled.where(F.col("tier") == REVIEW))
    placed = attach_one(position(waiting, "jsd", "_key", out="queue_pos", descending=True), pool)
    return placed.where(F.col("queue_pos") <= F.floor(F.col("pool") * dbl(share))).drop("_key", "pool")


def _keyed(df: DataFrame) -> DataFrame:
    """Numeric tie-break key that orders by image, then dimension."""
    spot = F.array_position(F.array(*[F.lit(d) for d in ("color", "overall", "sharpness")]), F.col("dimension"))
    return df.withColumn("_key", F.col("image_id") * 4 + spot)


def apply_veto(labelled: DataFrame, queue: DataFrame, judge: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Mark queued rows whose parsed judge score is ``threshold`` or more away and set
    their weight to 0. Rows without a parsed score are never vetoed."""
    asked = queue.select(*KEYS, F.lit(True).alias("_asked"))
    joined = labelled.join(asked, KEYS, "left").join(judge.select(*KEYS, "judge_score"), KEYS, "left")
    veto = F.coalesce(F.col("_asked") & (F.abs(F.col("judge_score") - F.col("mos")) >= threshold), F.lit(False))
    return joined.withColumn("vetoed", veto).withColumn("weight", F.when(veto, dbl(0)).otherwise(F.col("weight"))).drop("_asked")


def accepted(labelled: DataFrame, min_weight: float = 0.3) -> DataFrame:
    return labelled.where((F.col("weight") >= min_weight) & (F.col("tier") != REJECT) & ~F.col("vetoed"))


# ---- spread between raters ---------------------------------------------------------

def fit_normaliser(panel: DataFrame, by=("model",), min_rows: int = 10) -> DataFrame:
    """Mean and population std per rater; the job fails on too few or constant scores."""
    params = panel.groupBy(*by).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    bad = (F.col("n") < min_rows) | (F.col("std") < 1e-10)
    guard = F.when(bad, F.raise_error(F.concat(F.lit("cannot normalise "), F.concat_ws("/", *by))).cast("double"))
    return params.withColumn("std", F.coalesce(guard, F.col("std")))


def normalise(panel: DataFrame, params: DataFrame, by=("model",)) -> DataFrame:
    """z-scores; raters without parameters are skipped."""
    fitted = params.select(*by, "mean", "std")
    return panel.join(fitted, list(by)).withColumn("z", (F.col("score") - F.col("mean")) / F.col("std")).drop("mean", "std")


def spread_per_image(normalised: DataFrame, vision: Sequence[str], language: Sequence[str], min_models: int = 2) -> DataFrame:
    """Population std of the z-scores, gap between two rater groups, raters used."""
    group_mean = lambda names: F.avg(F.when(F.col("model").isin(*names), F.col("z")))
    per_image = normalised.groupBy("image_id").agg(
        F.round(F.stddev_pop("z"), 9).alias("spread"),
        F.coalesce(F.abs(group_mean(vision) - group_mean(language)), dbl(0)).alias("cluster_divergence"),
        F.count(F.lit(1)).cast("int").alias("n_spread_models"))
    return per_image.where(F.col("n_spread_models") >= min_models)


BASELINE_SHARES = {"median": 0.5, "q75": 0.75, "q90": 0.90, "q95": 0.95, "q99": 0.99}


def spread_baseline(spread: DataFrame, min_rows: int = 50) -> DataFrame:
    """One row: mean, std, quantiles, soft (p90) and hard (p99) limit; fails below ``min_rows``."""
    moments = spread.agg(F.count(F.lit(1)).alias("n_images"), F.avg("spread").alias("mean"), F.stddev_pop("spread").alias("std"))
    cut = quantiles(spread, "spread", BASELINE_SHARES).drop("size")
    row = attach_one(moments, cut)
    enough = F.when(F.col("n_images") < min_rows, F.raise_error(F.lit("too few images for a spread baseline")).cast("double"))
    return row.withColumn("soft_threshold", F.coalesce(enough, F.col("q90"))).withColumn("hard_threshold", F.col("q99"))


def ood_category(spread: Column, soft: Column, hard: Column) -> Column:
    return F.when(spread > hard, 2).when(spread > soft, 1).otherwise(0)


# ---- weights ------------------------------------------------------------------------

def absolute_weight(sigma_sq: Column, entropy: Column, sigma_range=(0.002, 0.019), entropy_range=(0.0, 0.693), floor=0.3) -> Column:
    unit = lambda v, lo, hi: clip((v - lo) / dbl(hi - lo), 0, 1) if hi > lo else dbl(0)
    return dbl(1) - dbl(1 - floor) * ((unit(sigma_sq, *sigma_range) + unit(entropy, *entropy_range)) / 2)


def rank_weight(df: DataFrame, by: Sequence[str] = (), floor: float = 0.3) -> DataFrame:
    """Weight from the mean of two unit ranks; a single row weighs 1."""
    ranked = unit_ranks(df, {"sigma_sq": "_s", "entropy": "_e"}, by)
    return ranked.withColumn("rank_weight", dbl(1) - dbl(1 - floor) * ((F.col("_s") + F.col("_e")) / 2)).drop("_s", "_e")


SCHEMES = ("uniform", "rank_tiers", "sigma_linear", "sigma_exp", "rank_average", "stepped")


def weighting_schemes(df: DataFrame, by: Sequence[str] = ("dimension",)) -> DataFrame:
    """One row per input row and scheme with its weight."""
    by = list(by)
    ranked = unit_ranks(df, {n: f"_u_{n}" for n in ("distance", "sigma_sq", "entropy")}, by)
    ranked = staged(ranked.withColumn("_c", F.round((F.col("_u_distance") + F.col("_u_sigma_sq") + F.col("_u_entropy")) / 3, 9)))
    cuts = quantiles(ranked, "_c", {"_p50": 0.5, "_p80": 0.8, "_p95": 0.95}, by).drop("size")
    tau = quantiles(df, "sigma_sq", {"_tau": 0.5}, by).drop("size")
    ends = df.groupBy(*by).agg(F.min("sigma_sq").alias("_lo"), F.max("sigma_sq").alias("_hi"))
    wide = attach(attach(attach(ranked, cuts, by), tau, by), ends, by)
    c, u = F.col, F.col("_u_sigma_sq")
    fade = lambda x: F.exp(-x / c("_tau"))
    width = fade(c("_lo")) - fade(c("_hi"))
    span = c("_hi") - c("_lo")
    weights = {
        "uniform": dbl(1),
        "rank_tiers": F.when(c("_c") > c("_p95"), dbl(0)).when(c("_c") > c("_p80"), dbl(0.3)).when(c("_c") > c("_p50"), dbl(0.6)).otherwise(dbl(1)),
        "sigma_linear": dbl(1) - dbl(0.7) * clip(F.coalesce(F.try_divide(c("sigma_sq") - c("_lo"), span), dbl(0)), 0, 1),
        "sigma_exp": F.when(width < 1e-8, dbl(1)).otherwise(dbl(0.3) + dbl(0.7) * (fade(c("sigma_sq")) - fade(c("_hi"))) / width),
        "rank_average": dbl(1) - dbl(0.7) * ((u + c("_u_entropy")) / 2),
        "stepped": F.when(u < 0.5, dbl(1)).when(u < 0.8, dbl(1) - dbl(0.5) * (u - 0.5) / dbl(0.3)).otherwise(dbl(0.5) - dbl(0.2) * (u - 0.8) / dbl(0.2)),
    }
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("scheme"), w.alias("scheme_weight")) for n, w in weights.items()]))
    return wide.select(*df.columns, rows)


def scheme_report(df: DataFrame, error: str, weight: str, by: Sequence[str]) -> DataFrame:
    """Weighted error, effective size and shares of rows by weight."""
    w, e = F.col(weight), F.col(error)
    share = lambda cond: F.avg(F.when(cond, dbl(100)).otherwise(dbl(0)))
    return df.groupBy(*by).agg(
        (F.sum(w * e) / F.sum(w)).alias("weighted_mae"), F.avg(F.when(w >= 0.5, e)).alias("high_conf_mae"),
        F.count(F.when(w >= 0.5, 1)).alias("high_conf_n"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"),
        F.avg(w).alias("mean_weight"), F.min(w).alias("min_weight"), share(w >= 0.95).alias("pct_full_weight"),
        share((w > 0.3) & (w < 0.95)).alias("pct_downweighted"), share(w <= 0.3).alias("pct_rejected"))


def percentile_tiers(df: DataFrame, by: Sequence[str] = ("dimension",)) -> DataFrame:
    """Tier from the mean unit rank of three signals, cut at its 50th, 80th and 95th percentile."""
    by = list(by)
    ranked = unit_ranks(df, {n: f"_u_{n}" for n in ("distance", "sigma_sq", "entropy")}, by)
    ranked = staged(ranked.withColumn("combined", F.round((F.col("_u_distance") + F.col("_u_sigma_sq") + F.col("_u_entropy")) / 3, 9)))
    cuts = quantiles(ranked, "combined", {"_p50": 0.5, "_p80": 0.8, "_p95": 0.95}, by).drop("size")
    c = F.col
    tier = F.when(c("combined") <= c("_p50"), AUTO).when(c("combined") <= c("_p80"), LOW).when(c("combined") <= c("_p95"), REVIEW).otherwise(REJECT)
    return attach(ranked, cuts, by).withColumn("tier", tier).select(*df.columns, "combined", "tier")


# ---- threshold profiles -----------------------------------------------------------------

def threshold_profiles(signal_rows: DataFrame, distances: DataFrame) -> DataFrame:
    """Seven named and five swept profiles, one row each, from the given rows' quantiles."""
    shares = lambda *ps: {f"p{str(p).replace('.', '_')}": p / 100 for p in ps}
    prefix = lambda df, tag: df.drop("size").select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c != "size"])
    dm = prefix(quantiles(distances, "distance", shares(90, 92, 95, 97, 99, 99.5)), "dm")
    sq = prefix(quantiles(signal_rows, "sigma_sq", shares(50, 75, 90, 95, 99)), "sq")
    en = prefix(quantiles(signal_rows, "entropy", shares(50, 75, 90, 95, 99)), "en")
    one = attach_one(attach_one(dm, sq), en)
    c, inf = F.col, dbl("inf")

    def row(name, ood, reject, auto, low):
        pick = lambda tag, p: dbl(p) if isinstance(p, float) else inf if p is None else c(f"{tag}_{p}")
        fixed = auto == "default"
        return F.struct(
            F.lit(name).alias("profile"), pick("dm", ood).alias("distance_ood"), pick("dm", reject).alias("distance_reject"),
            (dbl(0.64) if fixed else pick("sq", auto)).alias("sigma_sq_auto"), (dbl(1) if fixed else pick("sq", low)).alias("sigma_sq_low"),
            (dbl(1.2) if fixed else pick("en", auto)).alias("entropy_auto"), (dbl(1.5) if fixed else pick("en", low)).alias("entropy_low"))

    rows = [row("current", 46.0, 58.6, "default", None), row("data_calibrated", 46.0, 58.6, "p75", "p90"),
            row("strict", "p90", "p95", "p50", "p75"), row("moderate", "p95", "p99", "p75", "p90"),
            row("lenient", "p99", "p99_5", "p95", "p99"), row("dm_only", 46.0, 58.6, None, None),
            row("no_ood", None, None, "p75", "p90")]
    rows += [row(f"dm_p{p}", f"p{p}", "p99_5", "p75", "p90") for p in (90, 92, 95, 97, 99)]
    return one.select(F.inline(F.array(*rows)))


def decide_per_profile(signal_rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every row under every profile. The profiles travel as one array in a scalar
    subquery and are expanded next to each row, so nothing is joined or shuffled."""
    packed = profiles.agg(F.collect_list(F.struct(*profiles.columns)).alias("_all"))
    wide = attach_one(signal_rows, packed).withColumn("_p", F.explode("_all")).drop("_all")
    names = [c for c in profiles.columns if c != "profile"]
    judged = decide(wide, {n: F.col("_p")[n] for n in names}, with_jsd=False, with_reason=False)
    return judged.withColumn("profile", F.col("_p.profile")).drop("_p")


def tier_stats(df: DataFrame, by: Sequence[str], weight: str = "weight") -> DataFrame:
    """Rows, share and mean weight per tier plus the effective number of rows."""
    n = F.count(F.lit(1))
    cols = [n.alias("n_total")]
    for tier in TIERS:
        hit = F.count(F.when(F.col("tier") == tier, 1))
        cols += [hit.alias(f"n_{tier}"), (hit * 100 / n).alias(f"pct_{tier}")]
    return df.groupBy(*by).agg(*cols, F.avg(weight).alias("mean_weight"), F.sum(weight).alias("effective_n"))


# ---- divergence limits from errors -----------------------------------------------------

def equal_size_bins(df: DataFrame, value: str, key: str, by: Sequence[str], bins: int = 10, out: str = "bin") -> DataFrame:
    """Bins of ``size // bins`` rows by position; the remainder goes to the last bin."""
    placed = position(df, value, key, by, "_pos", size="_n")
    width = F.floor(F.col("_n") / bins)
    return placed.withColumn(out, F.least(F.coalesce(F.floor(F.try_divide(F.col("_pos") - 1, width)), F.lit(bins - 1)), F.lit(bins - 1)).cast("int"))


def jsd_limits(df: DataFrame, key: str, auto_error: float = 0.5, low_error: float = 0.75, min_rows: int = 20,
               default=(0.06, 0.12)) -> DataFrame:
    """Per dimension: divergence just below the first of ten bins whose mean error is
    over each limit, the largest divergence if none is, defaults for small groups."""
    binned = equal_size_bins(df, "jsd", key, ["dimension"])
    bins = binned.groupBy("dimension", "bin").agg(
        F.avg("error").alias("mae"), F.min("jsd").alias("first"), F.max("jsd").alias("last"), F.max("_n").alias("n"))
    # Ten rows per dimension from here on.
    w = Window.partitionBy("dimension").orderBy("bin")
    bins = bins.withColumn("below", F.coalesce(F.lag("last").over(w), F.col("first")))
    over = lambda limit: F.min_by("below", F.when(F.col("mae") > limit, F.col("bin")))
    out = bins.groupBy("dimension").agg(F.max("n").alias("n"), F.max("last").alias("_max"),
                                        over(auto_error).alias("_a"), over(low_error).alias("_l"))
    pick = lambda c, d: F.when(F.col("n") < min_rows, dbl(d)).otherwise(F.coalesce(c, "_max"))
    return out.select("dimension", "n", pick("_a", default[0]).alias("auto_accept"), pick("_l", default[1]).alias("low_weight"))


# ---- active learning ------------------------------------------------------------------------

def informativeness(labelled: DataFrame, cross_levels: DataFrame, sacred: DataFrame) -> DataFrame:
    """BALD and entropy per row with an optional partner; protected images never appear."""
    open_rows = labelled.join(sacred.select("image_id"), "image_id", "left_anti")
    members = F.filter(F.array("probs", "cross_probs"), lambda m: m.isNotNull())
    return open_rows.join(cross_levels, KEYS, "left").select(
        *KEYS, F.round(lv.bald(members), 9).alias("bald"), F.round(lv.entropy(F.col("probs")), 9).alias("entropy"),
        lv.mos(F.col("probs")).alias("mos"))


def iteration_log(agreement: DataFrame, scored: DataFrame, by: str, threshold: float, small: float = 0.01) -> DataFrame:
    """One row per iteration, in order of ``by``: change of both coefficients to the one before, mean BALD,
    samples above the threshold and whether the rank coefficient has settled.

    ``agreement`` has by, srcc and plcc, a row per iteration; ``scored`` has by and bald, a row per sample.
    The first iteration's changes are 1; one without samples has a mean and a count of 0.
    """
    bald = scored.groupBy(by).agg(F.avg("bald").alias("mean_bald"), F.count(F.when(F.col("bald") > threshold, 1)).alias("samples_above_threshold"))
    w = Window.partitionBy(F.lit(0)).orderBy(by)  # a row per iteration
    change = lambda c: F.when(F.row_number().over(w) == 1, dbl(1)).otherwise(F.col(c) - F.lag(c).over(w))
    rows = agreement.join(bald, by, "left").select(by, F.row_number().over(w).alias("iteration"), change("srcc").alias("srcc_delta"), change("plcc").alias("plcc_delta"),
                                                   F.coalesce("mean_bald", dbl(0)).alias("mean_bald"), F.coalesce("samples_above_threshold", F.lit(0)).cast("long").alias("samples_above_threshold"))
    return rows.withColumn("converged", F.coalesce(F.abs("srcc_delta") < small, F.lit(False)))


def annotation_queue(scored: DataFrame, labelled_ids: DataFrame, sacred: DataFrame, k: int) -> DataFrame:
    """The k most informative rows outside both exclusion lists, rounded for writing."""
    left = scored.join(labelled_ids.select("image_id"), "image_id", "left_anti").join(sacred.select("image_id"), "image_id", "left_anti")
    best = left.orderBy(F.desc("bald"), "image_id", "dimension").limit(k)
    return best.select(*KEYS, F.round("bald", 6).alias("bald_score"), F.round("entropy", 6).alias("entropy"),
                       F.round("mos", 4).alias("predicted_mos"))
