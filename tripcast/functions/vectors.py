"""Short vectors held as lists of columns, so the arithmetic stays in codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
TINY = 1e-3      # smallest divisor of a growth ratio
KERNEL = 25      # moving-average width


def growth_weighting(xs: Sequence[Column]) -> list[Column]:
    """Weight every step of a window by the growth since its first step.

    The ratios use the unweighted values; a previous value within ``TINY`` of
    zero is replaced by ``TINY``.
    """
    weight = F.lit(1.0)
    out = [xs[0] * weight]
    for before, x in zip(xs, xs[1:]):
        weight = weight * (x / F.when(F.abs(before) > TINY, before).otherwise(F.lit(TINY)))
        out.append(x * weight)
    return out


def dot(xs: Sequence[Column], weights: Sequence[Column | float], bias: Column | float = 0.0) -> Column:
    terms = [x * (w if isinstance(w, Column) else F.lit(float(w))) for x, w in zip(xs, weights)]
    return reduce(add, terms) + (bias if isinstance(bias, Column) else F.lit(float(bias)))


def moving_average_matrix(length: int, kernel: int = KERNEL) -> np.ndarray:
    """``A`` with ``A @ x`` the centred moving average of ``x``, both ends
    repeated beyond the window."""
    reach = (kernel - 1) // 2
    shares = np.zeros((length, length))
    for row in range(length):
        taps = np.clip(np.arange(row - reach, row + reach + 1), 0, length - 1)
        np.add.at(shares[row], taps, 1.0 / kernel)
    return shares


def moving_average(xs: Sequence[Column], kernel: int = KERNEL) -> list[Column]:
    return [dot(xs, row) for row in moving_average_matrix(len(xs), kernel)]


def trend_and_rest(xs: Sequence[Column], kernel: int = KERNEL) -> tuple[list[Column], list[Column]]:
    """Split a window into its moving average and what remains."""
    trend = moving_average(xs, kernel)
    return trend, [x - t for x, t in zip(xs, trend)]


def unscale(x: Column, mean: Column | float, scale: Column | float) -> Column:
    return x * scale + mean


def unscale_to_int(x: Column, mean: Column | float, scale: Column | float) -> Column:
    """Undo the scaling and round halves to even."""
    return F.rint(unscale(x, mean, scale)).cast("int")
