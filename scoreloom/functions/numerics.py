"""Scalar building blocks as plain Column expressions.

Nothing here runs Python per row: each function returns an expression that
stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Rational approximation of the error function in three ranges
# (W. J. Cody, "Rational Chebyshev approximations for the error function",
# Mathematics of Computation 23, 1969). Listed from the lowest power upwards.
ERF_SMALL_NUM = (3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02,
                 3.16112374387056560e00, 1.85777706184603153e-1)
ERF_SMALL_DEN = (2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02,
                 2.36012909523441209e01, 1.0)
ERFC_MID_NUM = (1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03,
                8.81952221241769090e02, 2.98635138197400131e02, 6.61191906371416295e01,
                8.88314979438837594e00, 5.64188496988670089e-1, 2.15311535474403846e-8)
ERFC_MID_DEN = (1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03,
                3.29079923573345963e03, 1.62138957456669019e03, 5.37181101862009858e02,
                1.17693950891312499e02, 1.57449261107098347e01, 1.0)
ERFC_FAR_NUM = (6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1,
                3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2)
ERFC_FAR_DEN = (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1,
                1.87295284992346725e00, 2.56852019228982242e00, 1.0)
ERF_SPLITS = (0.46875, 4.0)
INV_SQRT_PI = 5.6418958354775628695e-1


def dbl(value) -> Column:
    """A double literal."""
    return F.lit(float(value))


def _horner(x: Column, coefficients) -> Column:
    return reduce(lambda acc, c: acc * x + dbl(c), reversed(coefficients[:-1]), dbl(coefficients[-1]))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def erf(x: Column) -> Column:
    """Error function of a double column, accurate to about 1e-15."""

    def far(y, s):
        tail = lambda inv: inv * _horner(inv, ERFC_FAR_NUM) / _horner(inv, ERFC_FAR_DEN)
        return dbl(1) - F.exp(-s) / y * (dbl(INV_SQRT_PI) - let(dbl(1) / s, tail))

    def size(y):
        near = let(y * y, lambda s: y * _horner(s, ERF_SMALL_NUM) / _horner(s, ERF_SMALL_DEN))
        mid = dbl(1) - F.exp(-y * y) * _horner(y, ERFC_MID_NUM) / _horner(y, ERFC_MID_DEN)
        return F.when(y <= ERF_SPLITS[0], near).when(y <= ERF_SPLITS[1], mid).otherwise(far(y, y * y))

    return let(x, lambda v: F.signum(v) * let(F.abs(v), size))


def normal_cdf(z: Column) -> Column:
    return dbl(0.5) * (dbl(1) + erf(z / dbl(2.0**0.5)))


def key_hash(*parts) -> Column:
    """60-bit non-negative hash of the parts joined by ':'.

    Depends on values only, so random choices repeat under any partitioning
    and after a lost executor.
    """
    cols = [F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 15), 16, 10).cast("bigint")


def clip(x: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else dbl(lo)
    hi = hi if isinstance(hi, Column) else dbl(hi)
    return F.greatest(lo, F.least(hi, x))


def r6(x, digits: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, digits) + dbl(0)


def total(array: Column) -> Column:
    return F.aggregate(array, dbl(0), lambda acc, v: acc + v)


def safe_ratio(num: Column, den: Column, otherwise=None) -> Column:
    """num/den, or the fallback where the denominator is zero."""
    return F.coalesce(F.try_divide(num, den), otherwise if isinstance(otherwise, Column) else F.lit(otherwise).cast("double"))
