"""Samplers: DataFrame -> DataFrame with a position per drawn sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnset.functions.hashing import pick, uniform
from kilnset.operators.ranking import count_at_most, default_buckets, positions, running, with_buckets
from kilnset.session import checkpoint


def sequential(df: DataFrame, key: str) -> DataFrame:
    """Positions in ascending key order."""
    return positions(df, [key])


def permutation(df: DataFrame, key: str, seed: int, epoch=0, groups=(), total: str | None = None) -> DataFrame:
    """A full random permutation per epoch (and group); ``epoch`` may be a column."""
    shuffled = df.withColumn("__u", uniform("perm", seed, epoch, key))
    return positions(shuffled, ["__u", key], groups, uniform="__u", total=total).drop("__u")


def draws_with_replacement(df: DataFrame, key: str, seed: int, epoch: int = 0, num_samples: int | None = None) -> DataFrame:
    """``num_samples`` independent uniform draws (default: as many as rows)."""
    if num_samples is not None and num_samples <= 0:
        raise ValueError("num_samples must be positive")
    n = df.count()
    draws = df.sparkSession.range(num_samples or n).select(
        F.col("id").alias("draw"), pick(uniform("draw", seed, epoch, "id"), n).alias("pos")
    )
    return draws.join(positions(df, [key]), "pos").drop("pos")


def subset(df: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Rows named by ``index(pos, key)``, keeping its positions."""
    return df.join(index.select("pos", key), key)


def weighted_with_replacement(
    df: DataFrame, key: str, weight: Column, num_samples: int, seed: int, epoch: int = 0
) -> DataFrame:
    """Draws proportional to weights of any scale; rows of weight 0 or null are
    never drawn.

    Weights become whole numbers at the smallest power of ten that loses nothing
    of them (or the largest whose total stays exact), so sums don't depend on
    their order; a positive weight that would vanish is an error. Every row owns
    the interval [lo, lo + weight) of the running total; a draw takes the last
    interval starting at or below it.

    Rows lie in ranges of the key. The totals of the ranges (a few thousand at most)
    tell each draw its range, and rows and draws of a range are merged in one ordered
    scan. A range that is expected to get more than its share of draws, as a heavy row's
    is, is replicated, and its draws are dealt over the copies.
    """
    if num_samples <= 0:
        raise ValueError("num_samples must be positive")
    real = df.select(F.col(key).alias("__key"), weight.cast("double").alias("__w")).where("__w > 0")
    scale, count = _exact_scale(real)
    items = real.select("__key", F.round(F.col("__w") * scale).cast("bigint").alias("__w"))
    ranges = default_buckets(items, count)
    ranged = with_buckets(items, ["__key"], buckets=ranges, count=count).drop("__g")
    sums = sorted((r["__b"], r["total"]) for r in ranged.groupBy("__b").agg(F.sum("__w").alias("total")).collect())
    lows = [0]
    for _, size in sums:
        lows.append(lows[-1] + size)
    total = lows.pop()
    copies = [max(1, -(-size * len(sums) // total)) for _, size in sums]
    numbers, starts, copied = (F.array(*[F.lit(x) for x in xs]) for xs in ([b for b, _ in sums], lows, copies))

    place = F.array_position(numbers, F.col("__b")).cast("int") - 1
    own = ranged.select(
        "__b", F.explode(F.sequence(F.lit(0), F.get(copied, place) - 1)).alias("__copy"), "__key", "__w", F.get(starts, place).alias("__lo"))
    upto = F.sum("__w").over(Window.partitionBy("__b", "__copy").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0))
    spans = own.select("__b", "__copy", (F.col("__lo") + upto - F.col("__w")).alias("at"), F.lit(0).alias("kind"),
                       F.lit(0).cast("bigint").alias("no"), F.col("__key").alias("owner"))
    draws = df.sparkSession.range(num_samples).select(
        F.col("id").alias("no"), pick(uniform("weighted", seed, epoch, "id"), F.lit(total)).alias("at"))
    spot = count_at_most(starts, len(lows), F.col("at")) - 1
    asked = draws.withColumn("__spot", spot).select(
        F.get(numbers, F.col("__spot")).alias("__b"), (F.col("no") % F.get(copied, F.col("__spot"))).cast("int").alias("__copy"),
        "at", F.lit(1).alias("kind"), "no", F.lit(None).cast(items.schema["__key"].dataType).alias("owner"))
    scan = Window.partitionBy("__b", "__copy").orderBy("at", "kind", "no").rowsBetween(Window.unboundedPreceding, 0)
    merged = spans.unionByName(asked).withColumn("hit", F.last("owner", ignorenulls=True).over(scan))
    return merged.where("kind = 1").select(F.col("no").alias("draw"), F.col("hit").alias(key))


#: Totals up to this many units are drawn from without rounding.
EXACT_TOTAL = 1 << 52


def _exact_scale(weights: DataFrame, digits: int = 15) -> tuple[float, int]:
    """Power of ten that turns the positive weights ``__w`` into whole numbers, and
    the number of weights."""
    w = F.col("__w")
    loss = [F.max(F.try_divide(F.abs(w * 10.0**k - F.round(w * 10.0**k)), w * 10.0**k)).alias(f"k{k}") for k in range(digits + 1)]
    found = weights.agg(F.count("__w").alias("n"), F.sum("__w").alias("total"), F.min("__w").alias("least"), *loss).first()
    if not found["total"]:
        raise ValueError("all weights are zero")
    fits = [k for k in range(digits + 1) if found["total"] * 10.0**k < EXACT_TOTAL]
    if not fits:
        raise ValueError("weights are too large to be summed exactly")
    scale = 10.0 ** next((k for k in fits if found[f"k{k}"] < 1e-12), fits[-1])
    if found["least"] * scale < 0.5:
        raise ValueError("the smallest weight vanishes beside the total")
    return scale, found["n"]


#: Up to so many draws without replacement are found with a bounded heap in each task.
HEAP_DRAWS = 10_000


def weighted_without_replacement(
    df: DataFrame, key: str, weight: Column, num_samples: int, seed: int, epoch: int = 0, heap: int = HEAP_DRAWS
) -> DataFrame:
    """Exponential-race sample: the ``num_samples`` smallest ``-ln(1-U)/w``.

    Up to ``heap`` are found with a heap in each task. For more, rows are counted by ranges of
    the race, the ranges that can hold a winner are kept, and only these are ranked."""
    raced = df.withColumn("__w", weight.cast("double")).where("__w > 0").withColumn(
        "__race", -F.log(F.lit(1.0) - uniform("race", seed, epoch, key)) / F.col("__w")
    )
    if num_samples <= heap:
        won = raced.orderBy("__race", key).limit(num_samples)
    else:
        ranged = with_buckets(raced, ["__race", key]).drop("__g")
        left, last = num_samples, None
        for b, n in sorted((r["__b"], r["count"]) for r in ranged.groupBy("__b").count().collect()):
            last = b
            left -= n
            if left <= 0:
                break
        won = ranged.where(F.col("__b") <= (-1 if last is None else last)).drop("__b")
    ranked = positions(checkpoint(won), ["__race", key], name="draw").where(F.col("draw") < num_samples)
    return ranked.drop("__w", "__race")


def distributed(
    df: DataFrame, key: str, replicas: int, seed: int, epoch: int = 0, shuffle: bool = True, drop_last: bool = False
) -> DataFrame:
    """Even shards: position p belongs to rank ``p % replicas``.

    Short tails are padded with the head, as often as needed when there are
    fewer rows than replicas; with ``drop_last`` the tail is cut instead.
    """
    if shuffle:
        ranked = permutation(df, key, seed, epoch, total="__n")
    else:
        ranked = positions(df, [key], total="__n")
    n, r = F.col("__n"), F.lit(replicas)
    if drop_last:
        per_rank = F.when(n % r == 0, F.floor(n / r)).otherwise(F.greatest(F.ceil((n - r) / r), F.lit(0)))
    else:
        per_rank = F.ceil(n / r)
    ranked = ranked.withColumn("__size", (per_rank * r).cast("bigint")).where(F.col("pos") < F.col("__size"))
    padded = ranked.withColumn("pos", F.explode(F.sequence("pos", F.col("__size") - 1, F.col("__n"))))
    return padded.select(
        *[c for c in df.columns], "pos", (F.col("pos") % r).alias("rank"),
        F.floor(F.col("pos") / r).alias("rank_pos"),
    )


def restore_order(df: DataFrame, send_idx: str, arrival: str, groups=()) -> DataFrame:
    """In-order delivery of out-of-order results: item i can leave once all of
    0..i have arrived, so it leaves at the running maximum of arrivals."""
    return running(df, {"released_at": ("max", F.col(arrival))}, [send_idx], groups)
