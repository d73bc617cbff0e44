"""Op catalogues and published policy tables as small DataFrames.

The larger searched policies (hundreds of sub-policies) are data, not code:
``read_policies`` loads them from JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Op name, low and high of the argument, per op family.
OP_RANGES = {
    "search": [
        ("ShearX", -0.3, 0.3), ("ShearY", -0.3, 0.3), ("TranslateX", -0.45, 0.45), ("TranslateY", -0.45, 0.45),
        ("Rotate", -30.0, 30.0), ("AutoContrast", 0.0, 1.0), ("Invert", 0.0, 1.0), ("Equalize", 0.0, 1.0),
        ("Solarize", 0.0, 256.0), ("Posterize", 4.0, 8.0), ("Contrast", 0.1, 1.9), ("Color", 0.1, 1.9),
        ("Brightness", 0.1, 1.9), ("Sharpness", 0.1, 1.9), ("Cutout", 0.0, 0.2),
    ],
    "autoaugment_extra": [
        ("CutoutAbs", 0.0, 20.0), ("Posterize2", 0.0, 4.0), ("TranslateXAbs", 0.0, 10.0), ("TranslateYAbs", 0.0, 10.0),
    ],
    "crop_extra": [
        ("Identity", 0.0, 1.0), ("RandFlip", 0.0, 1.0), ("RandCutout", 0.0, 1.0), ("RandCrop", 0.0, 1.0),
        ("RandResizeCrop_imagenet", 0.0, 1.0), ("RandCutout60", 0.0, 1.0),
    ],
    "randaugment": [
        ("AutoContrast", 0.0, 1.0), ("Equalize", 0.0, 1.0), ("Invert", 0.0, 1.0), ("Rotate", 0.0, 30.0),
        ("Posterize", 0.0, 4.0), ("Solarize", 0.0, 256.0), ("SolarizeAdd", 0.0, 110.0), ("Color", 0.1, 1.9),
        ("Contrast", 0.1, 1.9), ("Brightness", 0.1, 1.9), ("Sharpness", 0.1, 1.9), ("ShearX", 0.0, 0.3),
        ("ShearY", 0.0, 0.3), ("CutoutAbs", 0.0, 40.0), ("TranslateXabs", 0.0, 100.0), ("TranslateYabs", 0.0, 100.0),
    ],
}

# Ops the gpu lane and the weighted policy use.
GPU_OPS = ["Rotate", "Contrast", "Brightness", "ShearX", "ShearY", "TranslateXabs", "TranslateYabs"]
OP_RANGES["staged"] = [r for r in OP_RANGES["randaugment"] if r[0] != "CutoutAbs"]
OP_RANGES["gpu"] = [r for r in OP_RANGES["randaugment"] if r[0] in GPU_OPS]
OP_RANGES["weighted"] = [r for r in OP_RANGES["search"] if r[0] != "Cutout"] + [("Identity", 0.0, 1.0)]
SEARCH_OPS = [name for name, _, _ in OP_RANGES["search"]]

# Op order of the tensor-style random policy.
TENSOR_OPS = [
    "AutoContrast", "Equalize", "Invert", "Rotate", "Posterize", "Solarize", "Color", "Contrast", "Brightness",
    "Sharpness", "ShearX", "ShearY", "TranslateX", "TranslateY", "Cutout", "SolarizeAdd",
]

# Published AutoAugment sub-policies, two (op, probability, magnitude) each; None where the op takes
# no magnitude.
PUBLISHED = {
    "imagenet": [
        (("Posterize", 0.4, 8), ("Rotate", 0.6, 9)),
        (("Solarize", 0.6, 5), ("AutoContrast", 0.6, None)),
        (("Equalize", 0.8, None), ("Equalize", 0.6, None)),
        (("Posterize", 0.6, 7), ("Posterize", 0.6, 6)),
        (("Equalize", 0.4, None), ("Solarize", 0.2, 4)),
        (("Equalize", 0.4, None), ("Rotate", 0.8, 8)),
        (("Solarize", 0.6, 3), ("Equalize", 0.6, None)),
        (("Posterize", 0.8, 5), ("Equalize", 1.0, None)),
        (("Rotate", 0.2, 3), ("Solarize", 0.6, 8)),
        (("Equalize", 0.6, None), ("Posterize", 0.4, 6)),
        (("Rotate", 0.8, 8), ("Color", 0.4, 0)),
        (("Rotate", 0.4, 9), ("Equalize", 0.6, None)),
        (("Equalize", 0.0, None), ("Equalize", 0.8, None)),
        (("Invert", 0.6, None), ("Equalize", 1.0, None)),
        (("Color", 0.6, 4), ("Contrast", 1.0, 8)),
        (("Rotate", 0.8, 8), ("Color", 1.0, 2)),
        (("Color", 0.8, 8), ("Solarize", 0.8, 7)),
        (("Sharpness", 0.4, 7), ("Invert", 0.6, None)),
        (("ShearX", 0.6, 5), ("Equalize", 1.0, None)),
        (("Color", 0.4, 0), ("Equalize", 0.6, None)),
        (("Equalize", 0.4, None), ("Solarize", 0.2, 4)),
        (("Solarize", 0.6, 5), ("AutoContrast", 0.6, None)),
        (("Invert", 0.6, None), ("Equalize", 1.0, None)),
        (("Color", 0.6, 4), ("Contrast", 1.0, 8)),
        (("Equalize", 0.8, None), ("Equalize", 0.6, None)),
    ],
    "cifar10": [
        (("Invert", 0.1, None), ("Contrast", 0.2, 6)),
        (("Rotate", 0.7, 2), ("TranslateX", 0.3, 9)),
        (("Sharpness", 0.8, 1), ("Sharpness", 0.9, 3)),
        (("ShearY", 0.5, 8), ("TranslateY", 0.7, 9)),
        (("AutoContrast", 0.5, None), ("Equalize", 0.9, None)),
        (("ShearY", 0.2, 7), ("Posterize", 0.3, 7)),
        (("Color", 0.4, 3), ("Brightness", 0.6, 7)),
        (("Sharpness", 0.3, 9), ("Brightness", 0.7, 9)),
        (("Equalize", 0.6, None), ("Equalize", 0.5, None)),
        (("Contrast", 0.6, 7), ("Sharpness", 0.6, 5)),
        (("Color", 0.7, 7), ("TranslateX", 0.5, 8)),
        (("Equalize", 0.3, None), ("AutoContrast", 0.4, None)),
        (("TranslateY", 0.4, 3), ("Sharpness", 0.2, 6)),
        (("Brightness", 0.9, 6), ("Color", 0.2, 8)),
        (("Solarize", 0.5, 2), ("Invert", 0.0, None)),
        (("Equalize", 0.2, None), ("AutoContrast", 0.6, None)),
        (("Equalize", 0.2, None), ("Equalize", 0.6, None)),
        (("Color", 0.9, 9), ("Equalize", 0.6, None)),
        (("AutoContrast", 0.8, None), ("Solarize", 0.2, 8)),
        (("Brightness", 0.1, 3), ("Color", 0.7, 0)),
        (("Solarize", 0.4, 5), ("AutoContrast", 0.9, None)),
        (("TranslateY", 0.9, 9), ("TranslateY", 0.7, 9)),
        (("AutoContrast", 0.9, None), ("Solarize", 0.8, 3)),
        (("Equalize", 0.8, None), ("Invert", 0.1, None)),
        (("TranslateY", 0.7, 9), ("AutoContrast", 0.9, None)),
    ],
    "svhn": [
        (("ShearX", 0.9, 4), ("Invert", 0.2, None)),
        (("ShearY", 0.9, 8), ("Invert", 0.7, None)),
        (("Equalize", 0.6, None), ("Solarize", 0.6, 6)),
        (("Invert", 0.9, None), ("Equalize", 0.6, None)),
        (("Equalize", 0.6, None), ("Rotate", 0.9, 3)),
        (("ShearX", 0.9, 4), ("AutoContrast", 0.8, None)),
        (("ShearY", 0.9, 8), ("Invert", 0.4, None)),
        (("ShearY", 0.9, 5), ("Solarize", 0.2, 6)),
        (("Invert", 0.9, None), ("AutoContrast", 0.8, None)),
        (("Equalize", 0.6, None), ("Rotate", 0.9, 3)),
        (("ShearX", 0.9, 4), ("Solarize", 0.3, 3)),
        (("ShearY", 0.8, 8), ("Invert", 0.7, None)),
        (("Equalize", 0.9, None), ("TranslateY", 0.6, 6)),
        (("Invert", 0.9, None), ("Equalize", 0.6, None)),
        (("Contrast", 0.3, 3), ("Rotate", 0.8, 4)),
        (("Invert", 0.8, None), ("TranslateY", 0.0, 2)),
        (("ShearY", 0.7, 6), ("Solarize", 0.4, 8)),
        (("Invert", 0.6, None), ("Rotate", 0.8, 4)),
        (("ShearY", 0.3, 7), ("TranslateX", 0.9, 3)),
        (("ShearX", 0.1, 6), ("Invert", 0.6, None)),
        (("Solarize", 0.7, 2), ("TranslateY", 0.6, 7)),
        (("ShearY", 0.8, 4), ("Invert", 0.8, None)),
        (("ShearX", 0.7, 9), ("TranslateY", 0.8, 3)),
        (("ShearY", 0.8, 5), ("AutoContrast", 0.7, None)),
        (("ShearX", 0.7, 2), ("Invert", 0.1, None)),
    ],
    "detection_v0": [
        (("Equalize", 0.8, 1), ("ShearY", 0.8, 4)),
        (("Color", 0.4, 9), ("Equalize", 0.6, 3)),
        (("Color", 0.4, 1), ("Rotate", 0.6, 8)),
        (("Solarize", 0.8, 3), ("Equalize", 0.4, 7)),
        (("Solarize", 0.4, 2), ("Solarize", 0.6, 2)),
        (("Color", 0.2, 0), ("Equalize", 0.8, 8)),
        (("Equalize", 0.4, 8), ("SolarizeAdd", 0.8, 3)),
        (("ShearX", 0.2, 9), ("Rotate", 0.6, 8)),
        (("Color", 0.6, 1), ("Equalize", 1.0, 2)),
        (("Invert", 0.4, 9), ("Rotate", 0.6, 0)),
        (("Equalize", 1.0, 9), ("ShearY", 0.6, 3)),
        (("Color", 0.4, 7), ("Equalize", 0.6, 0)),
        (("Posterize", 0.4, 6), ("AutoContrast", 0.4, 7)),
        (("Solarize", 0.6, 8), ("Color", 0.6, 9)),
        (("Solarize", 0.2, 4), ("Rotate", 0.8, 9)),
        (("Rotate", 1.0, 7), ("TranslateY", 0.8, 9)),
        (("ShearX", 0.0, 0), ("Solarize", 0.8, 4)),
        (("ShearY", 0.8, 0), ("Color", 0.6, 4)),
        (("Color", 1.0, 0), ("Rotate", 0.6, 2)),
        (("Equalize", 0.8, 4), ("Equalize", 0.0, 8)),
        (("Equalize", 1.0, 4), ("AutoContrast", 0.6, 2)),
        (("ShearY", 0.4, 7), ("SolarizeAdd", 0.6, 7)),
        (("Posterize", 0.8, 2), ("Solarize", 0.6, 10)),
        (("Solarize", 0.6, 8), ("Equalize", 0.6, 1)),
        (("Color", 0.8, 6), ("Rotate", 0.4, 5)),
    ],
}

# Sub-policies of the imagenet table that the staged pipeline has.
STAGED_IDS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17, 18, 19, 20, 21, 22, 24]


def published_rows(name: str) -> list[tuple[int, int, str, float, float | None]]:
    """(policy_id, op_idx, op, prob, level) of a published table or ``staged``."""
    listed = [PUBLISHED["imagenet"][i] for i in STAGED_IDS] if name == "staged" else PUBLISHED[name]
    return [(policy_id, op_idx, op, prob, None if level is None else float(level))
            for policy_id, policy in enumerate(listed) for op_idx, (op, prob, level) in enumerate(policy)]


POLICY_SCHEMA = "policy_id int, op_idx int, op string, prob double, level double"


def policy_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(published_rows(name), POLICY_SCHEMA)


def op_table(spark: SparkSession, family: str) -> DataFrame:
    rows = [(i, op, low, high) for i, (op, low, high) in enumerate(OP_RANGES[family])]
    return spark.createDataFrame(rows, "op_no int, op string, low double, high double")


def policy_lines(policies: DataFrame, sets: list[str]) -> DataFrame:
    """``value``: one JSON list ``[[[op, prob, level], ..], ..]`` per policy set
    (a set is a searched policy), sub-policies and ops in order."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    op = F.concat(F.lit('["'), "op", F.lit('",'), number("prob"), F.lit(","), number("level"), F.lit("]"))

    def listed(order, text):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda x: x["t"])
        return F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]"))

    subs = policies.withColumn("__op", op).groupBy(*sets, "policy_id").agg(listed("op_idx", "__op").alias("__sub"))
    return subs.groupBy(*sets).agg(listed("policy_id", "__sub").alias("value"))


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Policies written as JSON, one ``[[[op, prob, level], ..], ..]`` list per
    line, to policy rows numbered in file order within the list."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("policy_set"))
    listed = lines.select("policy_set", F.posexplode(F.from_json("value", "array<array<array<string>>>")).alias("policy_id", "ops"))
    return listed.select("policy_set", "policy_id", F.posexplode("ops").alias("op_idx", "o")).select(
        "policy_set", "policy_id", "op_idx", F.col("o")[0].alias("op"), F.col("o")[1].cast("double").alias("prob"),
        F.col("o")[2].cast("double").alias("level"))
