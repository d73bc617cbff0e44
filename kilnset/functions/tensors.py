"""Array functions on tensors and images (row-major height x width x channel)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnset.functions.binding import bind

# Published channel means and standard deviations.
CHANNEL_STATS = {
    "cifar": ((0.4914, 0.4822, 0.4465), (0.2023, 0.1994, 0.2010)),
    "imagenet": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
}


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    """Sum in array order."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def log_softmax(logits: Column) -> Column:
    def shifted(z, peak):
        norm = total(F.transform(z, lambda x: F.exp(x - peak)))
        return bind(lambda lse: F.transform(z, lambda x: x - lse), peak + F.log(norm))

    return bind(lambda z: bind(shifted, z, F.array_max(z)), logits)


def softmax(logits: Column) -> Column:
    def weights(z, peak):
        return F.transform(z, lambda x: F.exp(x - peak))

    return bind(
        lambda z: bind(
            lambda w: bind(lambda n: F.transform(w, lambda x: x / n), total(w)), bind(weights, z, F.array_max(z))),
        logits)


def one_hot(target: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == target, 1.0).otherwise(0.0))


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def target_rank(logits: Column, target: Column) -> Column:
    """1 for the best class; equal logits rank the lower class first."""

    def rank(z, own, t):
        ahead = F.transform(z, lambda x, i: F.when((x > own) | ((x == own) & (i < t)), 1).otherwise(0))
        return F.aggregate(ahead, F.lit(1), lambda acc, x: acc + x)

    return bind(lambda z, t: bind(rank, z, F.element_at(z, t + 1), t), logits, target)


def top_k(a: Column, k: int) -> Column:
    """Indices of the k largest values; equal values keep the lower index first."""
    keyed = F.transform(a, lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))
    return F.transform(F.slice(F.sort_array(keyed, False), 1, k), lambda s: -s["i"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists of a batch as doubles, and the length of each."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float), sizes


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def blend_arrays(a: Column, b: Column, weight_a: Column) -> Column:
    """Element-wise ``a*w + b*(1-w)`` of arrays of one length, a batch at a time."""

    @F.arrow_udf("array<double>")
    def blended(a: pa.Array, b: pa.Array, w: pa.Array) -> pa.Array:
        (x, n), (y, m) = _flat(a), _flat(b)
        if (n != m).any():
            raise ValueError("arrays of different lengths")
        each = np.repeat(w.to_numpy(zero_copy_only=False), n)
        return _lists(x * each + y * (1.0 - each), n)

    return blended(a, b, weight_a.cast("double"))


def add_scaled(a: Column, noise: Column, prop: Column, share: float) -> Column:
    """``a + noise * prop * share``: a longer noise is cut, a shorter one goes on in silence."""

    @F.arrow_udf("array<double>")
    def louder(a: pa.Array, b: pa.Array, p: pa.Array) -> pa.Array:
        (x, n), (y, m) = _flat(a), _flat(b)
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        place = np.arange(len(x)) - np.repeat(start, n)
        heard = place < np.repeat(m, n)
        other = np.zeros(len(x))
        begin = np.concatenate([[0], np.cumsum(m)[:-1]])
        other[heard] = y[(np.repeat(begin, n) + place)[heard]]
        return _lists(x + other * np.repeat(p.to_numpy(zero_copy_only=False), n) * share, n)

    return louder(a, noise, prop.cast("double"))


def standardise(a: Column) -> Column:
    """Zero mean, unit sample standard deviation."""

    def centred(x, mean):
        var = total(F.transform(x, lambda v: (v - mean) * (v - mean))) / (F.size(x) - 1)
        return bind(lambda std: F.transform(x, lambda v: (v - mean) / std), F.sqrt(var))

    return bind(lambda x: bind(centred, x, total(x) / F.size(x)), a)


def fit_length(a: Column, length: int) -> Column:
    """Cut to ``length`` or fill with zeros."""
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(F.slice(a, 1, length), pad)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def half_spectrum(a: pd.Series) -> pd.Series:
    """Magnitudes of the first half of the Fourier spectrum."""
    return a.map(lambda x: np.abs(np.fft.fft(np.asarray(x, dtype=float)))[: len(x) // 2])


def stft_magnitude(window: int, hop: int, fft: int):
    """Column function: square root of the magnitude of a centred Hann-window
    short-time transform, frames in rows, flattened."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series) -> pd.Series:
        shape = np.zeros(fft)
        start = (fft - window) // 2
        shape[start:start + window] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)

        def one(x):
            x = np.pad(np.asarray(x, dtype=float), fft // 2, mode="reflect")
            frames = np.lib.stride_tricks.sliding_window_view(x, fft)[::hop]
            return np.sqrt(np.abs(np.fft.rfft(frames * shape, axis=1))).ravel()

        return a.map(one)

    return run


def join_numbers(a: Column, sep: str = ",") -> Column:
    return F.array_join(a.cast("array<string>"), sep)


def weighted_checksum(a: Column) -> Column:
    """Order-sensitive sum, ``sum(x[i] * (i + 1))``."""
    return total(F.transform(a, lambda x, i: x.cast("double") * (i + 1)))


def literal_array(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])
