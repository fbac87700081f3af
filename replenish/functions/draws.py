"""Pseudo-random draws that are functions of the data.

A draw hashes ``seed|key|...`` with md5 and reads the first 52 bits, so a rerun,
a retried task and an independent SQL engine all see the same value. No state,
no shuffle, no dependence on partitioning.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# a double holds every draw plus a half exactly
DIGITS, RANGE = 13, 4503599627370496.0


def _key(seed, parts) -> Column:
    cols = [F.lit(str(seed))]
    cols += [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *cols)


def bits(seed, *parts) -> Column:
    """Integer draw in [0, 2**52)."""
    return F.conv(F.substring(F.md5(_key(seed, parts)), 1, DIGITS), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Uniform draw in the open interval (0, 1)."""
    return (bits(seed, *parts) + F.lit(0.5)) / F.lit(RANGE)


def below(n: Column, seed, *parts) -> Column:
    """Integer draw in [0, n)."""
    return F.floor(uniform(seed, *parts) * n.cast("double")).cast("bigint")


def normal(seed, *parts) -> Column:
    """Standard normal draw (Box-Muller over two sub-seeds)."""
    u1 = uniform(f"{seed}a", *parts)
    u2 = uniform(f"{seed}b", *parts)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def laplace(scale, u: Column) -> Column:
    """Laplace noise by inverse distribution function of a uniform column."""
    centred = u - F.lit(0.5)
    return -F.lit(float(scale)) * F.signum(centred) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def poisson1(u: Column, most: int = 12) -> Column:
    """Poisson draw with mean one by inverse distribution function.

    The tail beyond ``most`` is smaller than the draw's own resolution.
    """
    expr: Column = F.lit(0)
    cum, term = 0.0, math.exp(-1.0)
    for k in range(most):
        cum += term
        term /= k + 1
        expr = expr + (u >= F.lit(cum)).cast("int")
    return expr


def poisson1_values(draws: np.ndarray, most: int = 12) -> np.ndarray:
    """The draws of :func:`poisson1` for integer draws of :func:`bits`, outside Spark."""
    terms = math.exp(-1.0) / np.cumprod(np.maximum(np.arange(most), 1.0))
    cums = np.fromiter(itertools.accumulate(terms.tolist()), float, most)
    return np.searchsorted(cums, (draws + 0.5) / RANGE, side="right").astype(np.uint8)


def normal_value(seed, *parts) -> float:
    """The same draw as :func:`normal`, for one key, outside Spark."""

    def u(tag: str) -> float:
        text = "|".join([f"{seed}{tag}", *[str(p) for p in parts]])
        return (int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16) + 0.5) / RANGE

    return math.sqrt(-2.0 * math.log(u("a"))) * math.cos(2.0 * math.pi * u("b"))
