"""Five-level score distributions as Column expressions.

A distribution is ``array<double>`` of five probabilities, best level first:
excellent (5), good (4), fair (3), poor (2), bad (1).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numerics import clip, dbl, let, normal_cdf, total

LEVEL_NAMES = ("excellent", "good", "fair", "poor", "bad")
LEVEL_SCORES = (5.0, 4.0, 3.0, 2.0, 1.0)
EPS = 1e-12
EDGE_EPS = 1e-8
SIGMA_FLOOR = 0.1
TWO_LEVEL_BELOW_SIGMA = 0.15
BIN_CENTRES = (1.2, 1.6, 2.0, 2.4, 2.8, 3.2, 3.6, 4.0, 4.4, 4.8)
BIN_WIDTH = 0.4
# Level index (0 = excellent) of each of the ten bins.
BIN_TO_LEVEL = (4, 3, 3, 3, 2, 2, 1, 1, 1, 0)


def constants(values) -> Column:
    return F.array(*[dbl(v) for v in values])


def _uniform(n: int = 5) -> Column:
    return constants([1.0 / n] * n)


def scaled_to_one(p: Column, otherwise: Column | None = None) -> Column:
    """Divide by the total; the fallback (uniform) where there is no mass."""
    fallback = otherwise if otherwise is not None else _uniform()
    return let(p, lambda q: let(total(q), lambda mass: F.when(
        mass > 0, F.transform(q, lambda v: v / mass)).otherwise(fallback)))


def problem(p: Column) -> Column:
    """Why ``p`` is not a distribution, or NULL if it is one."""
    return (F.when(p.isNull() | (F.size(p) != 5), F.lit("length"))
            .when(F.exists(p, lambda v: v < -EPS), F.lit("negative"))
            .when(total(F.transform(p, lambda v: F.greatest(v, dbl(0)))) < EPS, F.lit("no mass")))


def checked(p: Column) -> Column:
    """Normalised distribution; the job fails on a malformed one."""
    floored = F.transform(p, lambda v: F.greatest(v, dbl(0)))
    why = problem(p)
    return F.when(why.isNull(), scaled_to_one(floored)).otherwise(
        F.raise_error(F.concat(F.lit("not a level distribution: "), why)).cast("array<double>"))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, dbl(0), lambda acc, v: acc + F.when(v > EPS, v * F.log(v)).otherwise(dbl(0)))


def kl(p: Column, q: Column) -> Column:
    """KL(p || q) in nats, infinite where q lacks mass that p has."""
    terms = F.zip_with(p, q, lambda a, b: F.when(a <= EPS, dbl(0))
                       .when(b <= EPS, dbl("inf")).otherwise(a * F.log(a / b)))
    return total(terms)


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in nats with a small constant inside the logs."""
    def term(a, b):
        mid = dbl(0.5) * (a + b) + EPS
        return a * F.log((a + EPS) / mid) + b * F.log((b + EPS) / mid)

    return dbl(0.5) * total(F.zip_with(p, q, term))


def jsd_bins(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two bin vectors floored at a small constant."""
    floor = lambda a: F.transform(a, lambda v: F.greatest(v, dbl(EPS)))

    def term(a, b):
        mid = dbl(0.5) * (a + b)
        return a * F.log(a / mid) + b * F.log(b / mid)

    return dbl(0.5) * total(F.zip_with(scaled_to_one(floor(p)), scaled_to_one(floor(q)), term))


def mean_distribution(members: Column) -> Column:
    """Element-wise mean of an array of distributions."""
    summed = F.aggregate(members, constants([0.0] * 5),
                         lambda acc, d: F.zip_with(acc, d, lambda a, b: a + b))
    return let(F.size(members), lambda n: F.transform(summed, lambda v: v / n))


def bald(members: Column) -> Column:
    """Entropy of the mean minus the mean entropy, at least 0, and 0 for fewer than two."""
    def gap(m):
        mean_h = F.aggregate(m, dbl(0), lambda acc, d: acc + entropy(d)) / F.size(m)
        return F.greatest(dbl(0), entropy(mean_distribution(m)) - mean_h)

    return let(members, lambda m: F.when(F.size(m) < 2, dbl(0)).otherwise(gap(m)))


def _one_hot_nearest(centres, mu: Column) -> Column:
    distances = F.transform(constants(centres), lambda c: F.abs(c - mu))
    spot = F.array_position(distances, F.array_min(distances))
    return F.transform(F.sequence(F.lit(1), F.lit(len(centres))),
                       lambda i: F.when(i == spot, dbl(1)).otherwise(dbl(0)))


def _gaussian_mass(mu: Column, sigma: Column, edges, centres) -> Column:
    """Normalised normal mass between consecutive descending or ascending edges."""
    sign = 1 if edges[0] < edges[-1] else -1

    def between(cdf):
        return F.zip_with(F.slice(cdf, 1, len(centres)), F.slice(cdf, 2, len(centres)), lambda a, b: (b - a) * sign)

    def mass(m, s):
        cdf = F.transform(constants(edges), lambda e: normal_cdf((e - m) / s))
        return scaled_to_one(let(cdf, between), _one_hot_nearest(centres, m))

    return let(mu, lambda m: let(sigma, lambda s: mass(m, s)))


def gaussian_levels(mu: Column, sigma: Column) -> Column:
    """Normal mass in the five unit bins around 5, 4, 3, 2, 1."""
    edges = [LEVEL_SCORES[0] + 0.5] + [v - 0.5 for v in LEVEL_SCORES]
    return _gaussian_mass(clip(mu, 1, 5), F.greatest(sigma, dbl(SIGMA_FLOOR)), edges, LEVEL_SCORES)


def gaussian_bins(mu: Column, sigma_sq: Column) -> Column:
    """Normal mass in ten bins of width 0.4."""
    edges = [BIN_CENTRES[0] - BIN_WIDTH / 2] + [c + BIN_WIDTH / 2 for c in BIN_CENTRES]
    return _gaussian_mass(clip(mu, 1, 5), F.greatest(F.sqrt(sigma_sq), dbl(SIGMA_FLOOR)), edges, BIN_CENTRES)


def two_level(mu: Column) -> Column:
    """Linear split of a score between its two neighbouring levels."""
    return let(clip(mu, 1, 5), lambda m: F.transform(
        constants(LEVEL_SCORES), lambda v: F.greatest(dbl(0), dbl(1) - F.abs(m - v))))


def two_level_padded(mos: Column) -> Column:
    """Two-level split whose cells are widened by 1e-8 on both sides; the lower cell wins on an edge."""
    cell = F.least(F.greatest(F.ceil(mos - EDGE_EPS) - 1, F.lit(1)), F.lit(4)).cast("double")
    left, right = cell - EDGE_EPS, cell + 1 + EDGE_EPS
    share = (mos - left) / (right - left)
    return F.transform(constants(LEVEL_SCORES),
                       lambda v: F.when(v == cell, (right - mos) / (right - left))
                       .when(v == cell + 1, share).otherwise(dbl(0)))


def floored_sigma(sigma_sq: Column) -> Column:
    return F.greatest(F.sqrt(F.greatest(sigma_sq, dbl(0))), dbl(SIGMA_FLOOR))


def prediction_levels(mu: Column, sigma_sq: Column) -> Column:
    """Two-level split for a confident prediction, normal mass otherwise."""
    return let(floored_sigma(sigma_sq), lambda sigma: F.when(
        sigma < TWO_LEVEL_BELOW_SIGMA, two_level(mu)).otherwise(gaussian_levels(mu, sigma)))


def mos(p: Column) -> Column:
    return total(F.zip_with(p, constants(LEVEL_SCORES), lambda a, w: a * w))


def std(p: Column, centre: Column | None = None) -> Column:
    def around(c):
        return F.sqrt(total(F.zip_with(p, constants(LEVEL_SCORES), lambda a, w: a * (w - c) * (w - c))))

    return let(mos(p) if centre is None else centre, around)


def from_named(probs: Column, logits: Column) -> Column:
    """Distribution from a map of probabilities, else from a map of logits; uniform without mass."""
    def picked(source, missing):
        return F.array(*[F.coalesce(F.try_element_at(source, F.lit(n)), dbl(missing)) for n in LEVEL_NAMES])

    raw = (F.when(probs.isNotNull(), picked(probs, 0.0))
           .when(logits.isNotNull(), F.transform(picked(logits, -1e6), lambda v: F.exp(v)))
           .otherwise(F.raise_error(F.lit("record has neither probs nor logits")).cast("array<double>")))
    return scaled_to_one(raw)


def softmax_levels(logits: Column) -> Column:
    return scaled_to_one(F.array(*[F.exp(F.element_at(logits, F.lit(n))) for n in LEVEL_NAMES]))


def named_levels(probs: Column) -> Column:
    """Open-set probabilities in level order, used as they are."""
    return F.array(*[F.element_at(probs, F.lit(n)) for n in LEVEL_NAMES])


def linear_fix(p: Column, score: Column) -> Column:
    """struct(alpha, beta) such that alpha*p + beta has mass 1 and mean ``score``.

    A mean of 3 leaves alpha to the small term below the line: there mass and mean are rounded to
    12 digits, so that it doesn't hang on the last bit of a sum. Anywhere else the line is taken as
    it is, since a rounded one can be 0.
    """
    mass = F.round(total(p), 12)

    def slope(e):
        below = F.when(F.abs(e) < 1e-11, F.round(e, 12)).otherwise(e) + 1e-9
        return (score - 3) / F.when(below == 0, dbl(1e-25)).otherwise(below)

    alpha = let(mos(p) - dbl(3) * total(p), slope)
    return let(alpha, lambda a: F.struct(a.alias("alpha"), ((dbl(1) - a * mass) / 5).alias("beta")))


def bins_to_levels(bins: Column) -> Column:
    """Fold ten bins into five levels; uniform where the bins are empty."""
    if_wrong = F.raise_error(F.lit("expected ten bins")).cast("array<double>")
    sums = []
    for level in range(5):
        members = [F.element_at(bins, i + 1) for i, target in enumerate(BIN_TO_LEVEL) if target == level]
        acc = members[0]
        for m in members[1:]:
            acc = acc + m
        sums.append(acc)
    return F.when(F.size(bins) == 10, scaled_to_one(F.array(*sums))).otherwise(if_wrong)


def gaussian_kl(mu_a, mu_b, sd_a, sd_b) -> Column:
    tiny = 1e-8
    return F.log(sd_b / (sd_a + tiny)) + (sd_a * sd_a + (mu_a - mu_b) * (mu_a - mu_b)) / (2 * sd_b * sd_b + tiny) - 0.5


def gaussian_js(mu_a, mu_b, sd_a, sd_b) -> Column:
    """Symmetrised KL against the moment-matched midpoint."""
    mid, spread = dbl(0.5) * (mu_a + mu_b), F.sqrt(dbl(0.5) * (sd_a * sd_a + sd_b * sd_b))
    return dbl(0.5) * gaussian_kl(mu_a, mid, sd_a, spread) + dbl(0.5) * gaussian_kl(mu_b, mid, sd_b, spread)


def gaussian_w2(mu_a, mu_b, sd_a, sd_b) -> Column:
    return F.sqrt((mu_a - mu_b) * (mu_a - mu_b) + (sd_a - sd_b) * (sd_a - sd_b))


def level_text(p: Column) -> Column:
    """Name of the most likely level, the first on ties."""
    return F.element_at(F.array(*[F.lit(n) for n in LEVEL_NAMES]),
                        F.array_position(p, F.array_max(p)).cast("int"))


def columns(p: Column, prefix: str = "p", digits: int = 6) -> list[Column]:
    """Five rounded scalar columns ``p5 .. p1`` of a distribution."""
    return [(F.round(F.element_at(p, i + 1), digits) + dbl(0)).alias(f"{prefix}{5 - i}") for i in range(5)]
