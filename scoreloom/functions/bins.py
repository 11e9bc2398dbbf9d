"""Ten-bin vectors of whole Arrow batches: the arithmetic of ``levels.gaussian_bins`` and ``levels.bins_to_levels``.

Expressions of arrays are worked out an element at a time; on a hundred million vectors that is most of a job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import numerics as nm
from .levels import BIN_CENTRES, BIN_TO_LEVEL, BIN_WIDTH, SIGMA_FLOOR

LISTS = T.ArrayType(T.DoubleType())


def _poly(x: np.ndarray, coefficients) -> np.ndarray:
    out = np.full_like(x, coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def _erf(x: np.ndarray) -> np.ndarray:
    y = np.abs(x)
    out = np.empty_like(y)
    near, far = y <= nm.ERF_SPLITS[0], y > nm.ERF_SPLITS[1]
    v = y[near]
    out[near] = v * _poly(v * v, nm.ERF_SMALL_NUM) / _poly(v * v, nm.ERF_SMALL_DEN)
    v = y[mid := ~near & ~far]
    out[mid] = 1 - np.exp(-v * v) * _poly(v, nm.ERFC_MID_NUM) / _poly(v, nm.ERFC_MID_DEN)
    v = y[far]
    inv = 1 / (v * v)
    out[far] = 1 - np.exp(-v * v) / v * (nm.INV_SQRT_PI - inv * _poly(inv, nm.ERFC_FAR_NUM) / _poly(inv, nm.ERFC_FAR_DEN))
    return np.sign(x) * out


def _total(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows))
    for column in rows.T:
        out = out + column
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def gaussian_bins(sigma_sq: float):
    """Function of a column of means: normal mass in ten bins, as ``levels.gaussian_bins`` for one variance."""
    sigma = max(sigma_sq ** 0.5, SIGMA_FLOOR)
    edges = np.array([BIN_CENTRES[0] - BIN_WIDTH / 2] + [c + BIN_WIDTH / 2 for c in BIN_CENTRES])

    @F.arrow_udf(LISTS)
    def bins(mu: pa.Array) -> pa.Array:
        m = mu.to_numpy(zero_copy_only=False).astype(np.float64)
        m = np.where(np.isnan(m), 5.0, np.clip(m, 1.0, 5.0))  # clip() of a missing value is the upper end
        cdf = 0.5 * (1 + _erf(((edges - m[:, None]) / sigma) / 2.0**0.5))
        mass = cdf[:, 1:] - cdf[:, :-1]
        return _lists(mass / _total(mass)[:, None])

    return bins


@F.arrow_udf(LISTS)
def bins_to_levels(bins: pa.Array) -> pa.Array:
    """Ten bins folded into five levels as by ``levels.bins_to_levels``: uniform where they are empty."""
    if bins.null_count or (bins.value_lengths().to_numpy() != 10).any():
        raise ValueError("expected ten bins")
    flat = bins.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 10)
    missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, 10).any(axis=1)
    sums = np.stack([_total(values[:, [i for i, target in enumerate(BIN_TO_LEVEL) if target == level]]) for level in range(5)], axis=1)
    mass = _total(sums)
    with np.errstate(all="ignore"):
        levels = np.where((missing | (mass <= 0))[:, None], 0.2, sums / mass[:, None])
    return _lists(levels)
