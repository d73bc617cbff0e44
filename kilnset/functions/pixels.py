"""Pixel kernels: numpy functions on one image, run in chains over Arrow batches.

A kernel takes an image (height x width x channel, bytes) and its numbers and
returns an image, perhaps of another size. Geometry follows the pixel-centre,
nearest-neighbour convention; results are clipped, then truncated. Fill colours
are the last numbers of a step, one or one per channel.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

LUMA = np.array([19595, 38470, 7471])


def blend(a, b, factor: float) -> np.ndarray:
    """``a + factor * (b - a)``, clipped to 0..255 and truncated."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    return np.clip(a + factor * (b - a), 0.0, 255.0).astype(np.uint8)


def grey(img: np.ndarray) -> np.ndarray:
    """Grey value per pixel, weights 19595, 38470, 7471 in 1/65536."""
    if img.shape[2] == 1:
        return img[:, :, 0].astype(np.int64)
    return (img[:, :, :3].astype(np.int64) @ LUMA + 32768) >> 16


def _table(img: np.ndarray, table) -> np.ndarray:
    """Every value through a table of 256 entries."""
    return np.clip(table, 0, 255).astype(np.uint8)[img]


VALUES = np.arange(256)


def solarize(img, threshold):
    return _table(img, np.where(VALUES < threshold, VALUES, 255 - VALUES))


def solarize_add(img, addition, threshold=128.0):
    moved = np.clip(VALUES + int(addition), 0, 255)
    return _table(img, np.where(moved < threshold, moved, 255 - moved))


def solarize_add_below(img, addition, threshold=128.0):
    return _table(img, np.where(VALUES < threshold, VALUES + int(addition), VALUES))


def posterize(img, bits, at_least=0.0):
    step = 2 ** (8 - max(int(bits), int(at_least)))
    return _table(img, VALUES - VALUES % step)


def brightness(img, factor):
    return _table(img, blend(0.0, VALUES, factor))


def contrast(img, factor):
    light = grey(img)
    return _table(img, blend(float(math.floor(int(light.sum()) / light.size + 0.5)), VALUES, factor))


def contrast_count(img, factor):
    """About pixels / 256, as one port of this op does."""
    return _table(img, blend(float(img.shape[0] * img.shape[1] // 256), VALUES, factor))


def colour(img, factor):
    return blend(grey(img)[:, :, None], img, factor)


def smooth(img):
    """3 x 3 mean with centre weight 5, over 13; the border is kept."""
    out = img.copy()
    h, w, _ = img.shape
    if h > 2 and w > 2:
        x = img.astype(np.int64)
        near = 4 * x[1:-1, 1:-1]
        for dy in range(3):
            for dx in range(3):
                near = near + x[dy:h - 2 + dy, dx:w - 2 + dx]
        out[1:-1, 1:-1] = np.floor(near / 13.0 + 0.5)
    return out


def sharpness(img, factor):
    return blend(smooth(img), img, factor)


def autocontrast(img):
    """Stretch every channel to 0..255; a flat channel is unchanged."""
    out = img.copy()
    for ch in range(img.shape[2]):
        low, high = int(img[:, :, ch].min()), int(img[:, :, ch].max())
        if high > low:
            scale = 255.0 / (high - low)
            out[:, :, ch] = _table(img[:, :, ch], VALUES * scale - low * scale)
    return out


def equalize(img):
    """Histogram equalisation per channel."""
    out = img.copy()
    for ch in range(img.shape[2]):
        counts = np.bincount(img[:, :, ch].ravel(), minlength=256)
        below = np.cumsum(counts) - counts
        step = int(below[np.flatnonzero(counts)[-1]]) // 255
        if step:
            out[:, :, ch] = _table(img[:, :, ch], (step // 2 + below) // step)
    return out


def _picked(img, sx, sy, fill):
    """The pixels at (sx, sy), outside ones in the fill colour."""
    h, w, c = img.shape
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = img[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)]
    out[~inside] = _colour(fill, c)
    return out


def _colour(fill, channels: int) -> np.ndarray:
    return np.resize(np.asarray(fill or (0,), dtype=np.uint8), channels)


def affine(img, a, b, t, d, e, f, *fill):
    """Inverse affine map of pixel centres."""
    h, w, _ = img.shape
    cx, cy = (np.arange(w) + 0.5)[None, :], (np.arange(h) + 0.5)[:, None]
    sx = np.floor(a * cx + b * cy + t)
    sy = np.floor(d * cx + e * cy + f)
    return _picked(img, sx.astype(np.int64), sy.astype(np.int64), fill)


def shear_x(img, v, *fill):
    return affine(img, 1.0, v, 0.0, 0.0, 1.0, 0.0, *fill)


def shear_y(img, v, *fill):
    return affine(img, 1.0, 0.0, 0.0, v, 1.0, 0.0, *fill)


def translate_x(img, pixels, *fill):
    return affine(img, 1.0, 0.0, pixels, 0.0, 1.0, 0.0, *fill)


def translate_y(img, pixels, *fill):
    return affine(img, 1.0, 0.0, 0.0, 0.0, 1.0, pixels, *fill)


def translate_x_share(img, share, *fill):
    return translate_x(img, share * img.shape[1], *fill)


def translate_y_share(img, share, *fill):
    return translate_y(img, share * img.shape[0], *fill)


def rotate(img, cos, sin, *fill):
    """Counter-clockwise about the centre by the angle with this cosine and sine of its negative."""
    cx, cy = img.shape[1] / 2.0, img.shape[0] / 2.0
    return affine(img, cos, sin, cx - cos * cx - sin * cy, -sin, cos, cy + sin * cx - cos * cy, *fill)


def flip(img):
    return img[:, ::-1]


def crop(img, left, top, out_h, out_w, *fill):
    """Cut a box; parts outside the image take the fill colour."""
    sx = np.arange(int(out_w))[None, :] + int(left)
    sy = np.arange(int(out_h))[:, None] + int(top)
    return _picked(img, *np.broadcast_arrays(sx, sy), fill)


def pad_and_crop(img, size, off_x, off_y, *fill):
    """Pad by ``size`` on each side, then cut the old size at (off_x, off_y)."""
    return crop(img, off_x - size, off_y - size, img.shape[0], img.shape[1], *fill)


def _edge(v, n):
    return np.clip(v, 0, n - 1)


def _mirror(v, n):
    period = max(2 * (n - 1), 1)
    m = v % period
    return np.where(m < n, m, period - m)


def _pad(bend):
    def run(img, left, top, right, bottom, *fill):
        h, w, _ = img.shape
        sx = bend(np.arange(w + int(left) + int(right)) - int(left), w)
        sy = bend(np.arange(h + int(top) + int(bottom)) - int(top), h)
        return _picked(img, *np.broadcast_arrays(sx[None, :], sy[:, None]), fill)
    return run


def centre_crop(img, out_h, out_w):
    """Plain centre crop, zero padded when the image is smaller."""
    h, w, _ = img.shape
    out_h, out_w = int(out_h), int(out_w)
    left = -((out_w - w) // 2) if w < out_w else round((w - out_w) / 2.0)
    top = -((out_h - h) // 2) if h < out_h else round((h - out_h) / 2.0)
    return crop(img, left, top, out_h, out_w)


def _painted(img, x0, y0, x1, y1, fill):
    """Columns x0..x1 and rows y0..y1 (both ends included) in the fill colour."""
    out = img.copy()
    out[max(int(y0), 0):max(int(y1) + 1, 0), max(int(x0), 0):max(int(x1) + 1, 0)] = _colour(fill, img.shape[2])
    return out


def cutout_pixels(img, side, u_x, u_y, *fill):
    """Square of ``side`` pixels about a random point; its corner is clipped."""
    if side < 0:
        return img
    h, w, _ = img.shape
    x0, y0 = math.floor(max(u_x * w - side / 2.0, 0.0)), math.floor(max(u_y * h - side / 2.0, 0.0))
    return _painted(img, x0, y0, math.floor(min(w, x0 + side)), math.floor(min(h, y0 + side)), fill)


def cutout(img, share, u_x, u_y, *fill):
    """Side as a share of the width."""
    return img if share <= 0 else cutout_pixels(img, share * img.shape[1], u_x, u_y, *fill)


def cutout_clipped(img, size, u_x, u_y, *fill):
    """Box of half-width ``size // 2`` on both sides of a random point, clipped."""
    half = int(size) // 2
    ends = [math.floor(min(max(u * n + d, 0.0), float(n)))
            for d in (-half, half) for u, n in ((u_x, img.shape[1]), (u_y, img.shape[0]))]
    return _painted(img, *ends, fill)


def cutout_square(img, half, u_x, u_y, *fill):
    """Half-open box [centre - half, centre + half) about a random pixel."""
    cx, cy = math.floor(u_x * img.shape[1]), math.floor(u_y * img.shape[0])
    return _painted(img, cx - half, cy - half, cx + half - 1, cy + half - 1, fill)


def colour_jitter(img, f_bright, f_contrast, f_colour, first):
    """Brightness, contrast and saturation, starting at op ``first`` (0..2) and
    going round."""
    ops = ((brightness, f_bright), (contrast, f_contrast), (colour, f_colour))
    for k in range(3):
        op, factor = ops[(int(first) + k) % 3]
        img = op(img, factor)
    return img


def cubic_weights(start: float, length: float, size: int, out: int) -> np.ndarray:
    """out x size matrix of bicubic (a = -0.5) weights over [start, start + length)."""
    scale = length / out
    stretch = max(scale, 1.0)
    centre = start + (np.arange(out) + 0.5) * scale
    d = np.abs((np.arange(size)[None, :] + 0.5 - centre[:, None]) / stretch)
    near = (1.5 * d - 2.5) * d * d + 1
    far = ((-0.5 * d + 2.5) * d - 4) * d + 2
    m = np.where(d < 1, near, np.where(d < 2, far, 0.0))
    return m / m.sum(axis=1, keepdims=True)


def resize(img, left, top, box_w, box_h, out_h, out_w):
    """Bicubic resize of a box, rows first, rounded after each direction (to nine
    decimals before, so that the order of a sum decides nothing)."""
    def to_pixels(x):
        return np.clip(np.floor(np.round(x, 9) + 0.5), 0, 255)

    x = np.tensordot(cubic_weights(left, box_w, img.shape[1], int(out_w)), img.astype(float), (1, 1))
    x = to_pixels(x).transpose(1, 0, 2)
    return to_pixels(np.tensordot(cubic_weights(top, box_h, img.shape[0], int(out_h)), x, (1, 0))).astype(np.uint8)


def resize_whole(img, out_h, out_w):
    return resize(img, 0.0, 0.0, img.shape[1], img.shape[0], out_h, out_w)


KERNELS = {
    "identity": lambda img: img, "invert": lambda img: 255 - img, "solarize": solarize, "solarize_add": solarize_add,
    "solarize_add_below": solarize_add_below, "posterize": posterize, "brightness": brightness, "contrast": contrast,
    "contrast_count": contrast_count, "colour": colour, "sharpness": sharpness, "autocontrast": autocontrast,
    "equalize": equalize, "affine": affine, "shear_x": shear_x, "shear_y": shear_y, "translate_x": translate_x,
    "translate_y": translate_y, "translate_x_share": translate_x_share, "translate_y_share": translate_y_share, "rotate": rotate, "flip": flip, "crop": crop, "pad_and_crop": pad_and_crop,
    "pad": _pad(lambda v, n: v), "pad_edge": _pad(_edge), "pad_mirror": _pad(_mirror), "centre_crop": centre_crop,
    "cutout": cutout, "cutout_pixels": cutout_pixels, "cutout_clipped": cutout_clipped, "cutout_square": cutout_square,
    "colour_jitter": colour_jitter, "resize": resize, "resize_whole": resize_whole,
}


def image(raw: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(h, w, -1)


#: Bytes that are worked on, or handed on, at once: a batch may hold 10,000 images.
PIECE_BYTES = 1 << 20


def pieces(batches):
    """The batches in slices of about ``PIECE_BYTES``, one row at least."""
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE_BYTES // max(batch.nbytes, 1))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def run_chains(px: str, h: str, w: str, steps: str):
    """Batch function: each row's steps over its image, new size included."""

    def run(batches):
        for batch in pieces(batches):
            names = [n for n in batch.schema.names if n != steps]
            cells = zip(batch[px], batch[h].to_pylist(), batch[w].to_pylist(), batch[steps].to_pylist())
            out, heights, widths, size = [], [], [], 0
            for end, (raw, high, wide, chain) in enumerate(cells, 1):
                if not raw.is_valid or high is None or wide is None:
                    out.append(None)
                    heights.append(high)
                    widths.append(wide)
                else:
                    img = image(raw.as_buffer(), high, wide)
                    for step in chain or ():
                        if step["op"] not in KERNELS:
                            raise ValueError(f"unknown op {step['op']}")
                        img = KERNELS[step["op"]](img, *step["args"])
                    out.append(np.ascontiguousarray(img).tobytes())
                    heights.append(img.shape[0])
                    widths.append(img.shape[1])
                    size += img.size
                # steps may enlarge images
                if size >= PIECE_BYTES or end == batch.num_rows:
                    done = batch.slice(end - len(out), len(out))
                    fresh = {px: pa.array(out, pa.binary()), h: pa.array(heights, pa.int32()), w: pa.array(widths, pa.int32())}
                    yield pa.RecordBatch.from_arrays([fresh.get(n, done[n]) for n in names], names)
                    out, heights, widths, size = [], [], [], 0

    return run
