"""Op arguments from levels and magnitudes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEVEL = 10.0

# Fixed values per magnitude space: top shear, translate (share of the size,
# or pixels), top rotation, top enhancement, posterize start and range.
SPACES = {
    "autoaugment": {"shear": 0.3, "share": 150.0 / 331.0, "rotate": 30.0, "enhance": 0.9, "bits": (8, 4)},
    "wide": {"shear": 0.99, "pixels": 32.0, "rotate": 135.0, "enhance": 0.99, "bits": (8, 6)},
    "augmix": {"shear": 0.3, "share": 1.0 / 3.0, "rotate": 30.0, "enhance": 0.9, "bits": (4, 4)},
}
# Op order of the binned policies.
BINNED_OPS = [
    "Identity", "ShearX", "ShearY", "TranslateX", "TranslateY", "Rotate", "Brightness", "Color", "Contrast",
    "Sharpness", "Posterize", "Solarize", "AutoContrast", "Equalize",
]
AUGMIX_OPS = [
    "ShearX", "ShearY", "TranslateX", "TranslateY", "Rotate", "Posterize", "Solarize", "AutoContrast", "Equalize",
    "Brightness", "Color", "Contrast", "Sharpness",
]
SIGNED = ["ShearX", "ShearY", "TranslateX", "TranslateY", "Rotate", "Brightness", "Color", "Contrast", "Sharpness"]


def rescale(level, low, high) -> Column:
    """Level in 0..1 to the op's range."""
    return level * (high - low) + low


def unscale(value, low, high) -> Column:
    """Inverse of ``rescale``."""
    return (value - low) / (high - low)


def random_policy_magnitude(m: float, low, high) -> Column:
    """Magnitude m of 30 within the op's range."""
    return F.lit(m / 30.0) * (high - low) + low


def float_parameter(level, top) -> Column:
    return level * top / MAX_LEVEL


def int_parameter(level, top) -> Column:
    return float_parameter(level, top).cast("int")


def level_argument(op: Column, level: Column, sign: Column, cutout: float, translate: float) -> Column:
    """Argument of the tensor-style ops from a level of 0..10; geometric ones
    take the random sign, ops without argument give null."""
    share = level / MAX_LEVEL
    whole = lambda x: x.cast("int").cast("double")
    return (
        F.when(op == "Rotate", share * 30.0 * sign)
        .when(op == "Posterize", whole(share * 4.0))
        .when(op == "Solarize", whole(share * 256.0))
        .when(op == "SolarizeAdd", whole(share * 110.0))
        .when(op.isin("Color", "Contrast", "Brightness", "Sharpness"), share * 1.8 + 0.1)
        .when(op.isin("ShearX", "ShearY"), share * 0.3 * sign)
        .when(op.isin("TranslateX", "TranslateY"), share * translate * sign)
        .when(op == "Cutout", whole(share * cutout)))


def searched_level(op: Column, level: Column) -> Column:
    """Published 0..10 magnitude -> argument in the searched ops' units."""
    enhanced = float_parameter(level, 1.8) + 0.1
    return (
        F.when(op.isin("ShearX", "ShearY"), float_parameter(level, 0.3))
        .when(op.isin("TranslateXAbs", "TranslateYAbs"), int_parameter(level, 10).cast("double"))
        .when(op == "Rotate", int_parameter(level, 30).cast("double"))
        .when(op == "Solarize", (256 - int_parameter(level, 256)).cast("double"))
        .when(op == "Posterize2", (4 - int_parameter(level, 4)).cast("double"))
        .when(op.isin("Contrast", "Color", "Brightness", "Sharpness"), enhanced)
        .when(op == "CutoutAbs", int_parameter(level, 20).cast("double"))
        .otherwise(level))


def bin_magnitude(space: str, op: Column, bin_no: Column, bins: int, height, width) -> Column:
    """Magnitude of one bin of ``bins`` evenly spaced ones."""
    s = SPACES[space]
    step = bin_no / F.lit(float(bins - 1))
    h, w = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))
    reach_x = F.lit(s["pixels"]) if "pixels" in s else w * s["share"]
    reach_y = F.lit(s["pixels"]) if "pixels" in s else h * s["share"]
    first, span = s["bits"]
    return (
        F.when(op.isin("ShearX", "ShearY"), step * s["shear"])
        .when(op == "TranslateX", step * reach_x)
        .when(op == "TranslateY", step * reach_y)
        .when(op == "Rotate", step * s["rotate"])
        .when(op.isin("Brightness", "Color", "Contrast", "Sharpness"), step * s["enhance"])
        .when(op == "Posterize", first - F.bround(bin_no / F.lit((bins - 1) / span)))
        .when(op == "Solarize", F.lit(255.0) - step * 255.0)
        .otherwise(F.lit(0.0)))


def is_signed(op: Column) -> Column:
    return op.isin(*SIGNED)
