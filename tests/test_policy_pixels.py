"""Planned policies on pixels against plain numpy, ranges and weighted draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnset.operators import policies as P

H = W = 8


def _image(seed=1):
    return np.random.default_rng(seed).integers(0, 256, (H, W, 3))


def _run(spark, family, op, arg, image, **more):
    rows = spark.createDataFrame(
        [(1, bytearray(image.astype(np.uint8).tobytes()), H, W, [(op, arg, True)])],
        "id long, px binary, h int, w int, ops array<struct<op:string,arg:double,applied:boolean>>")
    rows = rows.withColumn("ops", P.executable(F.col("ops"), family))
    out = P.augment_images(rows, "id", "px", "h", "w", 0, **more).first()
    return np.frombuffer(out["px"], np.uint8).reshape(out["h"], out["w"], 3).astype(int)


def _blend(low, image, factor):
    return np.trunc(np.clip(low + factor * (image - low), 0, 255)).astype(int)


@pytest.mark.parametrize("offset", [0.0, 0.5, -0.9])
def test_binned_enhancements_are_offsets_from_one(spark, offset):
    image = _image()
    assert (_run(spark, "binned", "Brightness", offset, image) == _blend(0, image, 1 + offset)).all()
    grey = (image @ np.array([19595, 38470, 7471]) + 32768) >> 16
    assert (_run(spark, "binned", "Color", offset, image) == _blend(grey[..., None], image, 1 + offset)).all()


@pytest.mark.parametrize("family", ["binned", "level"])
def test_translations_are_pixels(spark, family):
    image = _image()
    expected = np.zeros_like(image)
    expected[:, :-2] = image[:, 2:]
    assert (_run(spark, family, "TranslateX", 2.0, image) == expected).all()
    expected = np.zeros_like(image)
    expected[3:] = image[:-3]
    assert (_run(spark, family, "TranslateY", -3.0, image) == expected).all()


def test_level_ops(spark):
    image = _image()
    added = np.where(image < 128, np.minimum(image + 70, 255), image)
    assert (_run(spark, "level", "SolarizeAdd", 70.0, image) == added).all()
    assert (_run(spark, "level", "Contrast", 0.5, image) == _blend(np.full_like(image, H * W // 256), image, 0.5)).all()
    cut = (_run(spark, "level", "Cutout", 2.0, image) != image).any(axis=2)
    ys, xs = np.nonzero(cut)
    assert cut.any() and xs.max() - xs.min() <= 4 and ys.max() - ys.min() <= 4


def test_crop_ops_and_unknown_ops(spark):
    image = _image()
    flipped = _run(spark, "search", "RandFlip", 0.0, image)
    assert (flipped == image).all() or (flipped == image[:, ::-1]).all()
    assert (_run(spark, "search", "Identity", 0.0, image) == image).all()
    fill = np.array([125, 123, 114])
    grown = np.tile(fill, (H + 8, W + 8, 1))
    grown[4:-4, 4:-4] = image
    cropped = _run(spark, "search", "RandCrop", 0.0, image)
    assert any((cropped == grown[y:y + H, x:x + W]).all() for y in range(9) for x in range(9))
    whole = _run(spark, "search", "RandCutout", 0.0, image)
    assert ((whole == image).all(axis=2) | (whole == fill).all(axis=2)).all() and (whole == fill).all(axis=2).sum() >= 16
    with pytest.raises(Exception, match="unknown op NoSuchOp"):
        _run(spark, "search", "NoSuchOp", 0.0, image)


def test_resized_crop_is_a_stage(spark):
    """As an op of a plan it changes the size, and the ops after it see the new one."""
    flat = np.full((H, W, 3), 200)
    out = _run(spark, "search", "RandResizeCrop_imagenet", 0.0, flat, crop_size=12)
    assert out.shape == (12, 12, 3) and (out == 200).all()
    rows = spark.createDataFrame(
        [(1, bytearray(_image().astype(np.uint8).tobytes()), H, W, [("RandResizeCrop_imagenet", 0.0, True), ("TranslateX", 0.5, True)])],
        "id long, px binary, h int, w int, ops array<struct<op:string,arg:double,applied:boolean>>")
    out = P.augment_images(rows, "id", "px", "h", "w", 0).first()
    moved = np.frombuffer(out["px"], np.uint8).reshape(224, 224, 3)
    assert (out["h"], out["w"]) == (224, 224) and (moved[:, 112:] == 0).all() and moved[:, :112].any()


def test_large_policy_tables(spark):
    docs = spark.range(300).withColumnRenamed("id", "k")
    policy = spark.range(20000).selectExpr("cast(id as int) policy_id", "0 op_idx", "'Invert' op", "1.0D prob", "0.5D level")
    out = P.searched_policy(docs, "k", policy, 1)
    assert out.count() == 300 and out.select("policy_id").distinct().count() > 280
    cand = spark.range(12000).selectExpr("0 layer", "id cand_id", "1.0D weight", "'Invert' op", "cast(id % 10 as int) magnitude")
    assert P.weighted_layers(docs, "k", cand, 10, 1).where("size(ops) = 1").count() == 300


def test_weighted_draws_of_any_scale(spark):
    from kilnset.operators.sampling import weighted_with_replacement

    weights = [0.1, 0.9, 0.4, 0.7, 3.0, 0.6, 0.0]
    rows = spark.createDataFrame([(f"k{i}", w) for i, w in enumerate(weights)] + [("none", None)], "k string, w double")
    out = weighted_with_replacement(rows, "k", F.col("w"), 4000, 3)
    seen = {r["k"]: r["count"] for r in out.groupBy("k").count().collect()}
    assert set(seen) == {f"k{i}" for i, w in enumerate(weights) if w > 0}
    for i, w in enumerate(weights[:6]):
        mean = 4000 * w / sum(weights)
        assert abs(seen[f"k{i}"] - mean) < 5 * mean ** 0.5 + 5
    with pytest.raises(ValueError):
        weighted_with_replacement(rows, "k", F.lit(0.0), 10, 3)
    with pytest.raises(ValueError):
        weighted_with_replacement(rows, "k", F.when(F.col("k") == "k0", 1e-9).otherwise(1e12), 10, 3)


def test_ranges_with_repeated_keys(spark):
    """Most rows share one key, yet the others' ranges stay apart."""
    from kilnset.operators.ranking import positions, with_buckets

    rows = spark.range(20000).selectExpr("id", "case when id % 3 < 2 then 7 else id end as k")
    out = positions(rows, ["k", "id"]).orderBy("pos").collect()
    assert [r.pos for r in out] == list(range(20000))
    assert [(r.k, r.id) for r in out] == sorted((r.k, r.id) for r in out)
    sizes = [r["count"] for r in with_buckets(rows, ["k", "id"], buckets=64).groupBy("__b").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 2500


@pytest.mark.parametrize("alpha", [0.2, 0.5, 1.0, 2.5, 40.0])
def test_beta_draws(spark, alpha):
    from kilnset.functions.hashing import beta_symmetric

    rows = spark.range(20000).select("id", beta_symmetric(alpha, "b", 1, 0, "id").alias("x"))
    x = np.array([r.x for r in rows.orderBy("id").collect()])
    assert ((x >= 0) & (x <= 1)).all() and abs(x.mean() - 0.5) < 0.02
    assert abs(x.var() * 4 * (2 * alpha + 1) - 1) < 0.05
    again = np.array([r.x for r in rows.repartition(3).orderBy("id").collect()])
    assert (x == again).all()
