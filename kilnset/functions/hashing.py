"""Keyed uniforms: every random choice is a pure function of its key.

``uniform(tag, seed, epoch, key...)`` takes 52 bits of an md5, so a draw does
not depend on partitioning, task order or retries, and SQL can recompute it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnset.functions.binding import bind

TWO_52 = float(1 << 52)


def _text(value) -> Column:
    if isinstance(value, Column):
        return value.cast("string")
    return F.lit(str(value))


def uniform(tag: str, seed, epoch, *keys) -> Column:
    """A double in [0, 1) for the key; seed, epoch and keys may be columns."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(tag), _text(seed), _text(epoch), *[_text(c) for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(TWO_52)


def pick(u: Column, n) -> Column:
    """Index in 0..n-1 from a uniform."""
    return F.floor(u * n).cast("bigint")


def sign(u: Column) -> Column:
    """-1 for the lower half of the uniform, else 1."""
    return F.when(u < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))


def gaussian(u1: Column, u2: Column) -> Column:
    """Standard normal by Box-Muller from two uniforms."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def _stream(seed: np.ndarray, k: int) -> np.ndarray:
    """The k-th uniform of each seed, in (0, 1)."""
    x = seed + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(float) / TWO_52 + 2.0**-54


def _log_gamma_draw(alpha: float, seed: np.ndarray, first: int) -> np.ndarray:
    """Logarithms of Gamma(alpha) draws, a whole batch at a time: rejection from
    a normal for alpha + 1, then a power of a uniform."""
    d = alpha + 1.0 - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)
    out, open_, k = np.zeros(len(seed)), np.arange(len(seed)), first
    while len(open_):
        s = seed[open_]
        x = np.sqrt(-2.0 * np.log(_stream(s, k))) * np.cos(2.0 * math.pi * _stream(s, k + 1))
        v = (1.0 + c * x) ** 3
        fits = v > 0
        log_v = np.log(np.where(fits, v, 1.0))
        fits &= np.log(_stream(s, k + 2)) < 0.5 * x * x + d * (1.0 - v + log_v)
        out[open_[fits]] = math.log(d) + log_v[fits]
        open_, k = open_[~fits], k + 3
    return out + np.log(_stream(seed, first + (1 << 20))) / alpha


def beta_symmetric(alpha: float, tag: str, seed, epoch, *keys) -> Column:
    """Beta(alpha, alpha): the middle order statistic of uniforms where alpha is
    a whole number up to 32, otherwise the ratio of two Gamma draws, which follow
    from the keyed uniform."""
    if float(alpha).is_integer() and 1 <= alpha <= 32:
        k = int(alpha)
        draws = F.array(*[uniform(f"{tag}{i}", seed, epoch, *keys) for i in range(2 * k - 1)])
        return F.element_at(F.sort_array(draws), k)

    @F.pandas_udf("double")
    def draw(u: pd.Series) -> pd.Series:
        key = (u.to_numpy(dtype=float, na_value=0.0) * TWO_52).astype(np.uint64)
        gap = _log_gamma_draw(alpha, key, 2) - _log_gamma_draw(alpha, key, 1 << 21)
        return pd.Series(1.0 / (1.0 + np.exp(np.clip(-gap, -700, 700)))).where(u.notna().to_numpy())

    return draw(uniform(tag, seed, epoch, *keys))


def dirichlet_one(n: int, tag: str, seed, epoch, *keys) -> Column:
    """Dirichlet(1, .., 1) weights of length n: normalised exponentials."""
    draws = F.array(*[-F.log(F.lit(1.0) - uniform(f"{tag}{i}", seed, epoch, *keys)) for i in range(n)])
    return bind(
        lambda e: bind(
            lambda norm: F.transform(e, lambda x: x / norm), F.aggregate(e, F.lit(0.0), lambda a, x: a + x)),
        draws)
