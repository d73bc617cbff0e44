"""Choosing ops per sample.

Every policy adds ``ops``, an ordered array of (op, arg, applied). The choice
is a function of the sample key, so it needs no shuffle; only small fixed
tables are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnset.functions import images as I
from kilnset.functions import magnitudes as M
from kilnset.functions.binding import bind
from kilnset.functions.hashing import beta_symmetric, dirichlet_one, pick, sign, uniform
from kilnset.functions.pixels import pieces
from kilnset.functions.tensors import literal_array
from kilnset.sources.catalog import OP_RANGES, TENSOR_OPS


#: Sub-policies that are broadcast; larger tables are joined by shuffle.
BROADCAST_POLICIES = 10000
#: Candidates of all layers that travel as one value; a search has some hundreds.
MOST_CANDIDATES = 1 << 18


def _entry(op: Column, arg: Column, applied: Column) -> Column:
    return F.struct(op.alias("op"), arg.cast("double").alias("arg"), applied.alias("applied"))


def _policy_arrays(policy: DataFrame) -> DataFrame:
    """One row per sub-policy; policy tables are small and fixed."""
    return policy.groupBy("policy_id").agg(
        F.sort_array(F.collect_list(F.struct("op_idx", "op", "prob", "level"))).alias("__steps"))


def _with_subpolicy(df: DataFrame, key: str, policy: DataFrame, seed: int, epoch) -> DataFrame:
    arrays = _policy_arrays(policy)
    count = arrays.count()
    chosen = df.withColumn("policy_id", pick(uniform("subpolicy", seed, epoch, key), count).cast("int"))
    return chosen.join(F.broadcast(arrays) if count <= BROADCAST_POLICIES else arrays, "policy_id")


def _draw(tag, seed, epoch, key):
    return lambda i: uniform(tag, seed, epoch, key, i)


def searched_policy(df: DataFrame, key: str, policy: DataFrame, seed: int, epoch=0) -> DataFrame:
    """One random sub-policy per sample; each op runs when U <= prob, its
    level is scaled to the op's range."""
    gate = _draw("gate", seed, epoch, key)
    ranges = OP_RANGES["search"] + OP_RANGES["autoaugment_extra"]
    names = literal_array([r[0] for r in ranges])
    low, high = literal_array([r[1] for r in ranges]), literal_array([r[2] for r in ranges])

    def step(o, i):
        return bind(
            lambda at: _entry(o["op"], M.rescale(o["level"], F.get(low, at), F.get(high, at)), gate(i) <= o["prob"]),
            (F.array_position(names, o["op"]) - 1).cast("int"))

    return _with_subpolicy(df, key, policy, seed, epoch).withColumn("ops", F.transform("__steps", step)).drop("__steps")


def binned_policy(df: DataFrame, key: str, policy: DataFrame, height, width, seed: int, epoch=0) -> DataFrame:
    """Published policy: 10 magnitude bins by image size, random sign."""
    gate, side = _draw("gate", seed, epoch, key), _draw("sign", seed, epoch, key)

    def step(o, i):
        size = F.coalesce(M.bin_magnitude("autoaugment", o["op"], o["level"], 10, height, width), F.lit(0.0))
        arg = F.when(M.is_signed(o["op"]), size * sign(side(i))).otherwise(size)
        return _entry(o["op"], arg, gate(i) <= o["prob"])

    return _with_subpolicy(df, key, policy, seed, epoch).withColumn("ops", F.transform("__steps", step)).drop("__steps")


def level_policy(df: DataFrame, key: str, policy: DataFrame, seed: int, epoch=0, cutout=100.0, translate=250.0) -> DataFrame:
    """Sub-policy whose ops run when ``floor(u + prob)`` is one and whose
    levels of 0..10 turn into arguments."""
    gate, side = _draw("gate", seed, epoch, key), _draw("sign", seed, epoch, key)

    def step(o, i):
        arg = M.level_argument(o["op"], o["level"], sign(side(i)), cutout, translate)
        return _entry(o["op"], arg, F.floor(gate(i) + o["prob"]) >= 1)

    return _with_subpolicy(df, key, policy, seed, epoch).withColumn("ops", F.transform("__steps", step)).drop("__steps")


def _steps(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def random_policy(df: DataFrame, key: str, family: str, n: int, m: float, seed: int, epoch=0) -> DataFrame:
    """n ops drawn with replacement from a family, one shared magnitude m."""
    ranges = OP_RANGES[family]
    names = literal_array([r[0] for r in ranges])
    args = literal_array([m / 30.0 * (r[2] - r[1]) + r[1] for r in ranges])
    draw = _draw("op", seed, epoch, key)

    def step(i):
        return bind(lambda at: _entry(F.get(names, at), F.get(args, at), F.lit(True)), pick(draw(i), len(ranges)).cast("int"))

    return df.withColumn("ops", F.transform(_steps(n), step))


def binned_random_policy(
    df: DataFrame, key: str, n: int, magnitude: int | None, bins: int, height, width, seed: int, epoch=0, space="autoaugment"
) -> DataFrame:
    """n ops of 14 at one magnitude bin (or a random bin per op), random sign."""
    names = literal_array(M.BINNED_OPS)
    draw, side, slot = (_draw(x, seed, epoch, key) for x in ("op", "sign", "bin"))

    def step(i):
        bin_no = F.lit(magnitude) if magnitude is not None else pick(slot(i), bins)

        def entry(op, bin_no):
            size = M.bin_magnitude(space, op, bin_no, bins, height, width)
            return _entry(op, F.when(M.is_signed(op), size * sign(side(i))).otherwise(size), F.lit(True))

        return bind(entry, F.get(names, pick(draw(i), len(M.BINNED_OPS)).cast("int")), bin_no)

    return df.withColumn("ops", F.transform(_steps(n), step))


def one_op_policy(df: DataFrame, key: str, bins: int, seed: int, epoch=0) -> DataFrame:
    """One random op at a random bin of the wide space."""
    return binned_random_policy(df, key, 1, None, bins, 32, 32, seed, epoch, "wide")


def tensor_random_policy(df: DataFrame, key: str, layers: int, magnitude: float, seed: int, epoch=0, cutout=40.0, translate=100.0) -> DataFrame:
    """``layers`` draws of 16 tensor-style ops at one level."""
    names = literal_array(TENSOR_OPS)
    draw, side = _draw("op", seed, epoch, key), _draw("sign", seed, epoch, key)

    def step(i):
        return bind(
            lambda op: _entry(op, M.level_argument(op, F.lit(float(magnitude)), sign(side(i)), cutout, translate), F.lit(True)),
            F.get(names, pick(draw(i), len(TENSOR_OPS)).cast("int")))

    return df.withColumn("ops", F.transform(_steps(layers), step))


def mixed_chains(
    df: DataFrame, key: str, width: int, depth: int, severity: int, height, size_w, seed: int, epoch=0, all_ops: bool = True
) -> DataFrame:
    """One row per (sample, chain): the chain's ops, its mixing weight and the
    weight of the original. ``depth`` <= 0 draws 1..3 per chain."""
    ops = M.AUGMIX_OPS if all_ops else M.AUGMIX_OPS[:9]
    names = literal_array(ops)
    chains = df.withColumn("original_weight", beta_symmetric(1.0, "mix", seed, epoch, key)).withColumn(
        "__w", dirichlet_one(width, "chain", seed, epoch, key))
    chains = chains.select("*", F.posexplode("__w").alias("chain", "__share")).drop("__w")
    key_chain = (F.col(key), F.col("chain"))
    steps = F.lit(depth) if depth > 0 else (pick(uniform("depth", seed, epoch, *key_chain), 3) + 1).cast("int")

    def step(i):
        def entry(op, bin_no):
            size = M.bin_magnitude("augmix", op, bin_no, 10, height, size_w)
            flip = sign(uniform("sign", seed, epoch, *key_chain, i))
            return _entry(op, F.when(M.is_signed(op), size * flip).otherwise(size), F.lit(True))

        return bind(
            entry, F.get(names, pick(uniform("op", seed, epoch, *key_chain, i), len(ops)).cast("int")),
            pick(uniform("bin", seed, epoch, *key_chain, i), severity))

    return chains.withColumn("ops", F.transform(F.sequence(F.lit(0), steps - 1), step)).withColumn(
        "weight", F.col("__share") * (1 - F.col("original_weight"))).drop("__share")


def _mixed(batches):
    for batch in pieces(batches):
        out = []
        for original, share, chains in zip(batch["__o"], batch["__w0"].to_pylist(), batch["__c"].to_pylist()):
            total = np.frombuffer(original.as_buffer(), dtype=np.uint8) * share
            for chain in chains:
                total = total + np.frombuffer(chain["px"], dtype=np.uint8) * chain["weight"]
            out.append(np.round(total, 9).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch[0], pa.array(out, pa.binary())], [batch.schema.names[0], "mixed"])


def mix_chains(chains: DataFrame, key: str, original: str, augmented: str) -> DataFrame:
    """Weighted sum of the original and its chains (a few rows per sample), truncated
    to pixels (rounded to nine decimals before: the weights add up to one)."""
    grouped = chains.groupBy(key).agg(
        F.first(original).alias("__o"), F.first("original_weight").alias("__w0"),
        F.sort_array(F.collect_list(F.struct("chain", "weight", F.col(augmented).alias("px")))).alias("__c"))
    return grouped.mapInArrow(_mixed, f"`{key}` {dict(chains.dtypes)[key]}, mixed binary")


def weighted_layers(df: DataFrame, key: str, candidates: DataFrame, levels: int, seed: int, epoch=0) -> DataFrame:
    """One weighted draw per layer from ``candidates(layer, cand_id, weight,
    op, magnitude)``; arg = magnitude / (levels - 1) in the op's range. The
    candidates of a layer travel as one array with their cumulative weights, and
    a draw finds its place by binary search."""
    upto = Window.partitionBy("layer").orderBy("cand_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = candidates.withColumn("upto", F.sum("weight").over(upto))
    ordered = summed.groupBy("layer").agg(
        F.sort_array(F.collect_list(F.struct("cand_id", "upto", "op", "magnitude"))).alias("c"))
    folded = ordered.agg(F.sort_array(F.collect_list(F.struct("layer", "c"))).alias("__layers"))
    counted = candidates.groupBy("layer").count().agg(F.max("count"), F.sum("count")).first()
    largest, every = counted[0] or 1, counted[1] or 0
    if every > MOST_CANDIDATES:
        raise ValueError(f"{every} candidates travel with each task; at most {MOST_CANDIDATES} can")
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(largest.bit_length()))])
    draw = _draw("layer", seed, epoch, key)
    ranges = OP_RANGES["weighted"] + [r for r in OP_RANGES["crop_extra"] if r[0] != "Identity"]
    names = literal_array([r[0] for r in ranges])
    low, high = literal_array([r[1] for r in ranges]), literal_array([r[2] for r in ranges])

    def choose(layer, i):
        def found(c, target):
            at = F.aggregate(
                powers, F.lit(0),
                lambda a, p: F.when((a + p <= F.size(c)) & (F.get(c, a + p - 1)["upto"] <= target), a + p).otherwise(a))
            return bind(lambda at: finish(F.get(c, at)), F.least(at, F.size(c) - 1))

        def finish(x):
            return bind(
                lambda x, at: _entry(
                    x["op"], M.rescale(x["magnitude"] / F.lit(float(levels - 1)), F.get(low, at), F.get(high, at)), F.lit(True)),
                x, (F.array_position(names, F.substring_index(x["op"], ":", 1)) - 1).cast("int"))

        return bind(found, layer["c"], draw(i) * F.get(layer["c"], F.size(layer["c"]) - 1)["upto"])

    whole = df.withColumn("__layers", folded.scalar())
    return whole.withColumn("ops", F.transform("__layers", choose)).drop("__layers")


# Ordered stages per augmentation preset.
PRESETS = {
    "default": ["RandomResizedCrop", "RandomHorizontalFlip", "ToTensor", "Normalize"],
    "none": [],
    "randaugment": ["RandAugment", "RandomResizedCrop", "RandomHorizontalFlip", "ToTensor", "Normalize"],
    "croprandaugment": ["RandomResizedCrop", "RandAugment", "RandomHorizontalFlip", "ToTensor", "Normalize"],
    "resize_randaug": ["RandomResizedCrop", "RandAugment", "RandomHorizontalFlip", "ToTensor", "Normalize"],
    "autoaugment": ["AutoAugment", "RandomResizedCrop", "RandomHorizontalFlip", "ToTensor", "Normalize"],
    "cropautoaugment": ["RandomResizedCrop", "AutoAugment", "RandomHorizontalFlip", "ToTensor", "Normalize"],
    "deepautoaugment": ["DeepAutoAugment", "RandomResizedCrop", "RandomHorizontalFlip", "ToTensor", "Normalize"],
    "norandom": ["Resize", "CenterCrop", "HorizontalFlip", "ToTensor", "Normalize"],
    "randaugmentnorandom": ["Resize", "RandAugment", "CenterCrop", "HorizontalFlip", "ToTensor", "Normalize"],
}


def preset_stages(df: DataFrame, preset: Column) -> DataFrame:
    """Ordered stages of each sample's preset; an unknown name is an error."""
    stages = F.raise_error(F.lit("unknown preset")).cast("array<string>")
    for name, names in PRESETS.items():
        value = literal_array(names) if names else F.array().cast("array<string>")
        stages = F.when(preset == name, value).otherwise(stages)
    return df.withColumn("stages", stages)


def stage_order(df: DataFrame, family: str) -> DataFrame:
    """``stages``: Start, Decode, the sample's policy ops, RandomCrop,
    FlipAndNormalize (not in the weighted family) and Finish."""
    tail = ["RandomCrop", "Finish"] if family == "deepautoaugment" else ["RandomCrop", "FlipAndNormalize", "Finish"]
    chosen = F.transform("ops", lambda o: o["op"])
    return df.withColumn("stages", F.concat(literal_array(["Start", "Decode"]), chosen, literal_array(tail)))


def explode_plan(df: DataFrame, keep: list[str]) -> DataFrame:
    """Plan table: one row per (sample, step)."""
    return df.select(*keep, F.posexplode("ops").alias("step", "o")).select(*keep, "step", "o.op", "o.arg", "o.applied")


def executable(ops: Column, family: str) -> Column:
    """Planned ops in the one convention that ``pixel_step`` reads.

    There, enhancements are factors (1 changes nothing), shears are slopes,
    rotations degrees, ``TranslateX/Y`` and ``Cutout`` shares of the side and
    their ``Abs`` forms pixels. Families plan other units: "binned" offsets from
    factor 1 and pixels, "level" pixels, half a cut-out side, an addition below
    the threshold only, and a contrast about the pixel count. "search" plans are
    in the convention already.
    """
    absolute = {"TranslateX": "TranslateXAbs", "TranslateY": "TranslateYAbs"}
    names = {"search": {}, "binned": absolute, "level": absolute | {
        "Cutout": "CutoutAbs", "SolarizeAdd": "SolarizeAddBelow", "Contrast": "ContrastCount"}}[family]

    def entry(o):
        op, arg = o["op"], o["arg"]
        if family == "binned":
            arg = F.when(op.isin("Brightness", "Color", "Contrast", "Sharpness"), arg + 1.0).otherwise(arg)
        if family == "level":
            arg = F.when(op == "Cutout", arg * 2.0).otherwise(arg)
        new = op
        for old, name in names.items():
            new = F.when(op == old, F.lit(name)).otherwise(new)
        return _entry(new, arg, o["applied"])

    return F.transform(ops, entry)


# Kernel of each op of ``executable``'s convention, by the numbers that it takes.
PLAIN = {"Invert": "invert", "AutoContrast": "autocontrast", "Equalize": "equalize", "Identity": "identity"}
ONE_NUMBER = {
    "Solarize": "solarize", "SolarizeAdd": "solarize_add", "SolarizeAddBelow": "solarize_add_below", "Posterize": "posterize",
    "Posterize2": "posterize", "Brightness": "brightness", "Contrast": "contrast", "ContrastCount": "contrast_count",
    "Color": "colour", "Sharpness": "sharpness"}
SHIFTS = {
    "ShearX": "shear_x", "ShearY": "shear_y", "TranslateX": "translate_x_share", "TranslateY": "translate_y_share",
    "TranslateXAbs": "translate_x", "TranslateXabs": "translate_x", "TranslateYAbs": "translate_y", "TranslateYabs": "translate_y"}
CUTS = {"Cutout": "cutout", "CutoutAbs": "cutout_pixels"}
RANDOM_CUTS = {"RandCutout": 16, "RandCutout60": 60}
RESIZED = "RandResizeCrop_imagenet"


def pixel_step(op: Column, arg: Column, draw, h, w, replace=0, crop_size: int = 224) -> Column:
    """The kernel step of a planned op, its argument in the convention of
    ``executable``; ``draw(name)`` gives uniforms for random places, ``h`` and ``w``
    the size before the op. An unknown op is an error."""
    kernels = F.create_map(*[F.lit(x) for table in (PLAIN, ONE_NUMBER, SHIFTS, CUTS) for pair in table.items() for x in pair])
    place = (draw("cut_x"), draw("cut_y"))

    def numbers(*values):
        return F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("double") for v in values])

    # only the numbers of the branch that is taken are computed
    args = (
        F.when(op.isin(*ONE_NUMBER), numbers(arg)).when(op.isin(*SHIFTS), numbers(arg, replace))
        .when(op.isin(*CUTS), numbers(arg, *place, *I.MEAN_FILL)).otherwise(F.array().cast("array<double>")))
    named = F.struct(F.try_element_at(kernels, op).alias("op"), args.alias("args"))
    unknown = F.raise_error(F.concat(F.lit("unknown op "), op)).cast(I.STEP)
    out = F.when(op.isin(*PLAIN, *ONE_NUMBER, *SHIFTS, *CUTS), named)
    for name, size in RANDOM_CUTS.items():
        out = out.when(op == name, I.step("cutout_clipped", size, *place, fill=I.MEAN_FILL))
    box = I.random_resized_box(h, w, lambda name, k: draw(f"box_{name}{k}"))
    return (
        out.when(op == "Rotate", I.step("rotate", *I.angle(arg), fill=replace))
        .when(op == "RandFlip", I.when(draw("flip") > 0.5, I.step("flip")))
        .when(op == "RandCrop", I.step("pad_and_crop", 4, F.floor(draw("crop_x") * 9), F.floor(draw("crop_y") * 9), fill=I.MEAN_FILL))
        .when(op == RESIZED, bind(lambda b: I.step("resize", b["left"], b["top"], b["w"], b["h"], crop_size, crop_size), box))
        .otherwise(unknown))


def augment_images(df: DataFrame, key: str, px: str, h: str, w: str, seed: int, epoch=0, mirror: tuple = (), crop_size: int = 224) -> DataFrame:
    """Apply the planned ops in order; adds ``applied``, the list of (op, arg)
    that ran. ``mirror`` names ops whose argument takes a random sign. A random
    resized crop changes the image's size to ``crop_size``, and ``h`` and ``w`` with
    it. No shuffle: the plan travels in the row, and one pass runs all its steps."""

    def signed(o, i):
        turned = F.when(o["op"].isin(*mirror), o["arg"] * sign(uniform("mirror", seed, epoch, key, i))) if mirror else F.lit(None)
        return F.struct(o["op"].alias("op"), F.coalesce(turned, o["arg"]).alias("arg"), i.alias("step"))

    steps = F.transform("ops", lambda o, i: F.struct(signed(o, i).alias("s"), o["applied"].alias("run")))
    chosen = F.transform(F.filter(steps, lambda x: x["run"]), lambda x: x["s"])

    def kernel(s, i):
        before = F.exists(F.slice("applied", F.lit(1), i), lambda x: x["op"] == RESIZED)
        size = [F.when(before, crop_size).otherwise(F.col(n)) for n in (h, w)]
        return pixel_step(s["op"], s["arg"], lambda name: uniform(name, seed, epoch, key, s["step"]), *size, crop_size=crop_size)

    planned = df.withColumn("applied", chosen)
    return I.run(planned, F.transform("applied", kernel), px, h, w).withColumn(
        "applied", F.transform("applied", lambda s: F.struct(s["op"].alias("op"), s["arg"].alias("arg"))))
