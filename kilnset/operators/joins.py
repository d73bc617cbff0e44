"""Index lookups and pairings expressed as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnset.functions.hashing import beta_symmetric, pick, uniform
from kilnset.functions.tensors import add_scaled, blend_arrays
from kilnset.operators.ranking import positions, running
from kilnset.session import checkpoint


def class_index(df: DataFrame, name: str) -> DataFrame:
    """Dense index of the sorted distinct class names."""
    # one row per class, kept because ranking reads it several times
    return positions(checkpoint(df.select(name).distinct()), [name], name="target")


def synonym_index(classes: DataFrame, idx: str, names: str, sep: str = ", ") -> DataFrame:
    """One row per synonym of a class."""
    return classes.select(idx, F.explode(F.split(names, sep)).alias("class_name"))


def transcript_join(files: DataFrame, transcripts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(matched, orphan files): a file without transcript is an error row."""
    return files.join(transcripts, key), files.join(transcripts, key, "left_anti")


def resolve_addresses(requests: DataFrame, sizes: DataFrame, idx: str = "idx") -> DataFrame:
    """Global index -> (dataset, local index).

    ``sizes(ordinal, n)`` lists the datasets in order; negative indices count
    from the end; anything outside raises. Boundaries and requests are merged
    in one ordered scan instead of a range join.
    """
    sizes = checkpoint(sizes)
    bounds = running(sizes, {"hi": ("sum", F.col("n"))}, ["ordinal"]).select(
        F.struct("ordinal", (F.col("hi") - F.col("n")).alias("lo")).alias("owner"),
        (F.col("hi") - F.col("n")).alias("at"), F.lit(0).alias("kind"), F.col("ordinal").cast("bigint").alias("no"),
        F.lit(None).cast(requests.schema[idx].dataType).alias(idx), F.col("n"),
    ).where("n > 0").drop("n")
    total = sizes.agg(F.sum("n").alias("total"))
    asked = requests.groupBy(idx).agg(F.count(F.lit(1)).alias("times")).withColumn("total", total.scalar())
    place = F.when(F.col(idx) < 0, F.col(idx) + F.col("total")).otherwise(F.col(idx))
    bad = F.raise_error(F.lit("index exceeds dataset length")).cast("bigint")
    place = F.when((place < 0) | (place >= F.col("total")), bad).otherwise(place)
    asked = asked.select(
        F.lit(None).cast(bounds.schema["owner"].dataType).alias("owner"), place.cast("bigint").alias("at"),
        F.lit(1).alias("kind"), F.col(idx).cast("bigint").alias("no"), idx, "times",
    )
    merged = running(
        checkpoint(bounds.withColumn("times", F.lit(None).cast("bigint")).unionByName(asked)),
        {"hit": ("last", F.col("owner"))}, ["at", "kind", "no"])
    return merged.where("kind = 1").select(
        idx, "times", F.col("hit.ordinal").alias("ordinal"), (F.col("at") - F.col("hit.lo")).alias("local_idx"))


def concat_index(datasets: list[DataFrame], key: str) -> DataFrame:
    """Concatenation in order: ordinal, local position, global position."""
    tagged = [d.withColumn("ordinal", F.lit(i)) for i, d in enumerate(datasets)]
    whole = tagged[0]
    for d in tagged[1:]:
        whole = whole.unionByName(d)
    local = positions(whole, [key], ["ordinal"], name="local_idx")
    # one row per dataset of the given list
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n")).select(
        "ordinal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return local.join(F.broadcast(starts), "ordinal").withColumn(
        "global_idx", F.col("__start") + F.col("local_idx")).drop("__start")


def mixup(df: DataFrame, key: str, data: str, target: str, seed: int, epoch: int, alpha: float = 1.0) -> DataFrame:
    """Mix every row of a batch with a permuted row of the same batch; one
    lambda per batch, at least one half. Windows are per batch, so bounded."""
    in_batch = Window.partitionBy("batch_id").orderBy(uniform("mix", seed, epoch, key), key)
    rows = df.select("batch_id", "pos_in_batch", key, data, target)
    partner = rows.select(
        "batch_id", (F.row_number().over(in_batch) - 1).alias("pos_in_batch"), F.col(key).alias("partner"),
        F.col(data).alias("__other"), F.col(target).alias("partner_target"),
    )
    draw = beta_symmetric(alpha, "lam", seed, epoch, "batch_id")
    lam = F.greatest(draw, F.lit(1.0) - draw)
    return rows.join(partner, ["batch_id", "pos_in_batch"]).withColumn("lam", lam).withColumn(
        "mixed", blend_arrays(F.col(data), F.col("__other"), F.col("lam"))).drop("__other")


def random_partner(df: DataFrame, pool: DataFrame, key: str, pool_key: str, seed: int, tag: str = "pair") -> DataFrame:
    """Give every row of ``df`` one random row of ``pool`` (with replacement) by a
    join on the pool's positions. A pool with fewer rows than there are tasks is
    replicated, so that its few rows do not become few join keys; that adds at most
    two rows a task."""
    size = pool.count()
    tasks = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = max(1, -(-tasks // max(size, 1)))
    asked = df.withColumn("__at", pick(uniform(tag, seed, 0, key), size)).withColumn(
        "__copy", F.pmod(F.xxhash64(key), F.lit(copies)).cast("int"))
    ranked = positions(pool, [pool_key], name="__at").withColumn(
        "__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return asked.join(ranked, ["__at", "__copy"]).drop("__at", "__copy")


def sample_pairing(df: DataFrame, key: str, image: str, v: float, seed: int) -> DataFrame:
    """Blend each image with a random partner: ``(1-v)*a + v*b``."""
    pool = df.select(F.col(key).alias("partner"), F.col(image).alias("__other"))
    paired = random_partner(df, pool, key, "partner", seed)
    return paired.withColumn("paired", blend_arrays(F.col(image), F.col("__other"), F.lit(1.0 - v))).drop("__other")


def add_noise(df: DataFrame, noises: DataFrame, key: str, audio: str, noise_key: str, noise: str, scale: float, seed: int) -> DataFrame:
    """Add a random noise, cut to the audio's length and scaled by the ratio
    of the maxima; shorter noises are followed by silence."""
    pool = noises.select(F.col(noise_key).alias("noise_id"), F.col(noise).alias("__noise"))
    rows = random_partner(df, pool, key, "noise_id", seed, "noise")
    prop = F.array_max(audio).cast("double") / F.array_max("__noise").cast("double")
    noisy = add_scaled(F.col(audio), F.col("__noise"), F.col("prop"), scale)
    return rows.withColumn("prop", prop).withColumn("noisy", noisy).drop("__noise")
