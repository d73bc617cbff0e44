"""Image operations on binary pixels.

An image is one binary column, row-major height x width x channel bytes, with its
height and width beside it. An operation is a *step*, a struct of a kernel's name
and its numbers; numbers may be columns, so random places and signs stay functions
of the key and are drawn in the plan. ``run`` takes the steps of each row through
the kernels (``pixels``) in one pass over Arrow batches, so a whole policy costs one
trip to Python and no shuffle. Boxes and sizes are column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnset.functions import pixels
from kilnset.functions.binding import bind

# Fill colours, principal colour components.
MEAN_FILL = (125, 123, 114)
GREY_FILL = (128, 128, 128)
BLACK_FILL = (0, 0, 0)
PCA_EIGENVALUES = (0.2175, 0.0188, 0.0045)
PCA_EIGENVECTORS = ((-0.5675, 0.7192, 0.4009), (-0.5808, -0.0045, -0.8140), (-0.5836, -0.6948, 0.4203))
STEP = "struct<op: string, args: array<double>>"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _div(a, b) -> Column:
    return F.call_function("div", _c(a), _c(b)).cast("int")


def step(op: str, *numbers, fill=()) -> Column:
    """One step; the numbers and the fill colour's values may be columns."""
    fill = fill if isinstance(fill, (tuple, list)) else (fill,)
    values = [_c(x).cast("double") for x in (*numbers, *fill)]
    args = F.array(*values) if values else F.array().cast("array<double>")
    return F.struct(F.lit(op).alias("op"), args.alias("args"))


def when(condition: Column, then: Column) -> Column:
    """The step where the condition holds, else nothing to do."""
    return F.when(condition, then).otherwise(step("identity"))


def angle(degrees) -> tuple[Column, Column]:
    """The numbers of ``rotate``: counter-clockwise degrees."""
    r = -F.radians(_c(degrees))
    return F.round(F.cos(r), 15), F.round(F.sin(r), 15)


def run(df: DataFrame, steps, px: str = "px", h: str = "h", w: str = "w") -> DataFrame:
    """Take each row's image through ``steps``, a list of steps or a column of an
    array of them. Rows without an image or a size stay as they are; an unknown op is
    an error. Other columns pass through."""
    if isinstance(steps, (list, tuple)):
        steps = F.array(*steps) if steps else F.array().cast(f"array<{STEP}>")
    sized = df.withColumns({h: F.col(h).cast("int"), w: F.col(w).cast("int")})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in sized.schema])
    return sized.withColumn("__steps", steps).mapInArrow(pixels.run_chains(px, h, w, "__steps"), schema)


def to_bytes(df: DataFrame, name: str) -> DataFrame:
    """An array column of 0..255 as binary, whole batches at once."""
    def packed(batches):
        for batch in pixels.pieces(batches):
            lists = batch[name]
            values = lists.flatten().cast(pa.uint8())
            ends = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            raw = pa.Array.from_buffers(pa.large_binary(), len(lists), [
                None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values.to_numpy(zero_copy_only=False)).tobytes())])
            yield batch.set_column(batch.schema.get_field_index(name), name, raw.cast(pa.binary()))

    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == name else f.dataType) for f in df.schema])
    return df.mapInArrow(packed, schema)


def map_images(df: DataFrame, name: str, kind: str, body: Callable, inputs=(), px: str = "px", h: str = "h", w: str = "w") -> DataFrame:
    """Add a column of Spark type ``kind``: ``body(image, *inputs)`` of each image."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).add(name, kind)
    arrow = {"binary": pa.binary(), "double": pa.float64(), "string": pa.string()}[kind]

    def mapped(batches):
        for batch in pixels.pieces(batches):
            images = (pixels.image(raw.as_buffer(), a, b) for raw, a, b in zip(
                batch[px], batch[h].to_pylist(), batch[w].to_pylist()))
            more = [batch[i].to_pylist() for i in inputs]
            out = [body(img, *row) for img, *row in zip(images, *more)]
            yield batch.append_column(name, pa.array(out, arrow))

    return df.mapInArrow(mapped, schema)


def hwc_to_chw(df: DataFrame, out: str, px: str = "px", h: str = "h", w: str = "w") -> DataFrame:
    """Add the image with its channels one after the other."""
    return map_images(df, out, "binary", lambda img: np.ascontiguousarray(img.transpose(2, 0, 1)).tobytes(), (), px, h, w)


def chw_to_hwc(df: DataFrame, out: str, px: str = "px", h: str = "h", w: str = "w") -> DataFrame:
    """The way back."""
    def turn(img):
        high, wide, channels = img.shape
        return np.ascontiguousarray(img.reshape(channels, high, wide).transpose(1, 2, 0)).tobytes()

    return map_images(df, out, "binary", turn, (), px, h, w)


def tensor(img: np.ndarray, stats) -> np.ndarray:
    """``(p / 255 - mean[c]) / std[c]`` as doubles."""
    mean, std = (np.asarray(x[:img.shape[2]]) for x in stats)
    return (img / 255.0 - mean) / std


def weighted(values: np.ndarray) -> float:
    """Order-sensitive sum, ``sum(x[i] * (i + 1))`` of the flat values."""
    flat = values.ravel()
    return float(np.dot(flat, np.arange(1, flat.size + 1)))


def colour_shift(alphas) -> list[Column]:
    """The shift ``eigvec . (alpha * eigval)`` of each channel."""
    return [sum((F.lit(PCA_EIGENVECTORS[ch][k] * PCA_EIGENVALUES[k]) * alphas[k] for k in range(3)), F.lit(0.0)) for ch in range(3)]


def centre_box(h, w, size: int):
    """Box of side ``size / (size + 32) * short side``: left, top, side."""
    side = F.least(_c(h), _c(w)) * (float(size) / (size + 32))
    left = F.bround((_c(w) - side) / 2.0).cast("int")
    top = F.bround((_c(h) - side) / 2.0).cast("int")
    # end coordinates are rounded like the start
    right, bottom = F.bround(left + side).cast("int"), F.bround(top + side).cast("int")
    return left, top, right - left, bottom - top


def _first_valid(tries: Column, fallback: Column) -> Column:
    return F.coalesce(F.get(F.filter(tries, lambda t: t["ok"]), F.lit(0))["box"], fallback)


def _box(left, top, w, h) -> Column:
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def random_resized_box(h, w, draw, scale=(0.08, 1.0), ratio=(3 / 4, 4 / 3), attempts: int = 10) -> Column:
    """Crop box of random area and log-uniform aspect: first of ten tries that
    fits, else the largest centred box within the aspect limits.
    ``draw(name, attempt)`` gives uniforms."""
    hh, ww = _c(h), _c(w)
    area = (hh * ww).cast("double")
    log_low, log_high = math.log(ratio[0]), math.log(ratio[1])

    def attempt(k):
        def fit(bw, bh):
            left = F.floor(draw("left", k) * (ww - bw + 1))
            top = F.floor(draw("top", k) * (hh - bh + 1))
            ok = (bw > 0) & (bw <= ww) & (bh > 0) & (bh <= hh)
            return F.struct(ok.alias("ok"), _box(left, top, bw, bh).alias("box"))

        return bind(
            lambda target, aspect: bind(fit, F.bround(F.sqrt(target * aspect)), F.bround(F.sqrt(target / aspect))),
            area * (draw("area", k) * (scale[1] - scale[0]) + scale[0]),
            F.exp(draw("ratio", k) * (log_high - log_low) + log_low))

    aspect = ww / hh
    fw = F.when(aspect > max(ratio), F.bround(hh * max(ratio)).cast("int")).otherwise(ww)
    fh = F.when(aspect < min(ratio), F.bround(ww / min(ratio)).cast("int")).otherwise(hh)
    centred = _box(_div(ww - fw, 2), _div(hh - fh, 2), fw, fh)
    return _first_valid(F.array(*[attempt(k) for k in range(attempts)]), centred)


def covered_box(h, w, draw, size: int, min_covered=0.1, ratio=(3 / 4, 4 / 3), area=(0.08, 1.0), attempts: int = 10) -> Column:
    """Crop box by random aspect, then height: first valid try; a full-size
    box and ten failures fall back to the scaled centre box."""
    hh, ww = _c(h), _c(w)
    whole = (hh * ww).cast("double")
    low, high = whole * area[0], whole * area[1]
    left, top, side_w, side_h = centre_box(h, w, size)
    centre = _box(left, top, side_w, side_h)

    def attempt(k):
        def heights(aspect):
            most = F.bround(F.sqrt(high / aspect))
            fitted = F.floor((ww + 0.5 - 1e-7) / aspect)
            fitted = F.when(fitted * aspect > ww, fitted - 1).otherwise(fitted)
            most = F.least(F.when(most * aspect > ww, fitted).otherwise(most).cast("double"), hh.cast("double"))
            return bind(lambda most, lowest: sized(aspect, most, F.least(lowest, most)),
                        most, F.bround(F.sqrt(low / aspect)).cast("double"))

        def sized(aspect, most, lowest):
            return bind(lambda bh: bind(lambda bw: judged(bw, bh), F.bround(bh * aspect)),
                        F.bround(draw("height", k) * (most - lowest) + lowest))

        def judged(bw, bh):
            got = bw * bh
            ok = (got >= low) & (got <= high) & (bw <= ww) & (bh <= hh) & (got >= whole * min_covered)
            box = _box(F.floor(draw("left", k) * (ww - bw + 1)), F.floor(draw("top", k) * (hh - bh + 1)), bw, bh)
            return F.struct(ok.alias("ok"), F.when((bw == ww) & (bh == hh), centre).otherwise(box).alias("box"))

        return bind(heights, draw("aspect", k) * (ratio[1] - ratio[0]) + ratio[0])

    return _first_valid(F.array(*[attempt(k) for k in range(attempts)]), centre)


def short_side_size(h, w, size: int):
    """(height, width) after scaling the short side to ``size``."""
    hh, ww = _c(h), _c(w)
    out_w = F.when(ww <= hh, F.lit(size)).otherwise(F.floor(ww * size / hh)).cast("int")
    out_h = F.when(ww <= hh, F.floor(hh * size / ww)).otherwise(F.lit(size)).cast("int")
    return out_h, out_w
