"""Positions and running values without a single-partition window.

``row_number() over (order by k)`` moves every row to one task, and
``over (partition by g order by k)`` moves a hot group to one task. Here rows
go to ranges ("buckets") of the order first. Small per-bucket summaries are
scanned, joined back, and the rest is a window inside (group, bucket).

Buckets of a hashed order are equal slices of the uniform. For any other order
the cut points are quantiles of a bounded key sample, picked by hash, as
Spark's own global sort samples its range bounds. Cut points are taken
over (group, order) together, so a group with a third of all rows spans a third
of the buckets. Results never depend on the cut points.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnset.functions.binding import bind

#: Rows of a range: their number follows the data beyond twice the shuffle partitions.
ROWS_PER_BUCKET = 1 << 20
SAMPLES_PER_BUCKET = 12
#: Ranges at most, which bounds the key sample (12 keys each) and the cut points
#: in the plan; beyond 2^32 rows the ranges grow instead, and are sorted with spills.
MOST_BUCKETS = 1 << 12
#: Summary rows (one per range) that are broadcast; more are joined by shuffle.
BROADCAST_BUCKETS = 1 << 16


def default_buckets(df: DataFrame, rows: int) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MOST_BUCKETS, max(2 * parts, -(-rows // ROWS_PER_BUCKET))))


def _cuts(df: DataFrame, key: Column, buckets: int, rows: int):
    """Quantile cut points of the struct ``key``, from a random sample of about
    ``buckets * SAMPLES_PER_BUCKET`` rows of the whole input: a map-only scan of
    the key columns. Repeated keys count as often as they occur. The sample
    moves cut points, never results."""
    keys = df.select(key.alias("k"))
    if rows:
        keys = keys.where(F.rand(17) < min(1.0, buckets * SAMPLES_PER_BUCKET / rows))
    ordered = keys.agg(F.sort_array(F.collect_list("k")).alias("ks"))
    n = F.size("ks")
    step = F.transform(
        F.sequence(F.lit(1), F.lit(buckets - 1)),
        lambda i: F.get("ks", F.floor(i * n / buckets).cast("int")),
    )
    picked = ordered.select(F.array_distinct(F.filter(step, lambda x: x.isNotNull())).alias("cuts"))
    row = picked.select(F.to_json("cuts", {"ignoreNullFields": "false"}).alias("j"), "cuts")
    return row.select("j").first()["j"], row.schema["cuts"].dataType


def count_at_most(cuts: Column, count: int, key: Column) -> Column:
    """Binary search: how many of the ``count`` sorted entries are <= key."""
    powers = []
    p = 1
    while p <= count:
        powers.append(p)
        p *= 2
    if not powers:
        return F.lit(0)
    steps = F.array(*[F.lit(p) for p in reversed(powers)])
    return bind(
        lambda key: F.aggregate(
            steps, F.lit(0), lambda acc, s: F.when(F.get(cuts, acc + s - 1) <= key, acc + s).otherwise(acc)),
        key,
    )


def with_buckets(
    df: DataFrame,
    order: Sequence[str],
    groups: Sequence[str] = (),
    uniform: str | None = None,
    buckets: int | None = None,
    count: int | None = None,
) -> DataFrame:
    """Add ``__g`` (group struct, null safe) and ``__b`` (order range). ``count``
    is the number of rows, where it is known."""
    rows = df.count() if count is None and (uniform is None or not buckets) else count
    buckets = buckets or default_buckets(df, rows)
    group = F.struct(*[F.col(g) for g in groups]) if groups else F.lit(0)
    if uniform is not None:
        slot = F.least(F.floor(F.col(uniform) * buckets), F.lit(buckets - 1)).cast("int")
        # never null, so the join needs no second evaluation for a null filter
        return df.withColumn("__g", group).withColumn("__b", F.coalesce(slot, F.lit(0)))
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate([*groups, *order])])
    text, dtype = _cuts(df, key, buckets, rows)
    count = len(json.loads(text))
    cuts = F.from_json(F.lit(text), dtype)
    return df.withColumn("__g", group).withColumn(
        "__b", F.coalesce(count_at_most(cuts, count, key), F.lit(0)))


def _carry(summary: DataFrame, grouped: bool):
    """Windows over the per-bucket summary (at most one row per bucket and
    group), before the current bucket and over the whole group."""
    whole = Window.partitionBy("__g") if grouped else Window.partitionBy()
    return whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1), whole


def _join_summary(rows: DataFrame, summary: DataFrame, grouped: bool, buckets: int) -> DataFrame:
    if not grouped:
        # one row per bucket
        summary = summary.drop("__g")
        return rows.join(F.broadcast(summary) if buckets <= BROADCAST_BUCKETS else summary, "__b")
    return rows.join(summary, ["__g", "__b"])


def positions(
    df: DataFrame,
    order: Sequence[str],
    groups: Sequence[str] = (),
    uniform: str | None = None,
    name: str = "pos",
    total: str | None = None,
    buckets: int | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Zero-based position by ascending ``order`` (unique inside a group).

    ``ties`` order rows of equal ``order`` and cut no ranges: long columns belong
    here. The input is read for the count, the key sample, the bucket sizes and
    the rows themselves, the first three with key columns only: checkpoint an
    input that is costly to compute.
    """
    count = df.count() if uniform is None or not buckets else None
    buckets = buckets or default_buckets(df, count)
    rows = with_buckets(df, order, groups, uniform, buckets, count)
    summary = rows.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before, whole = _carry(summary, bool(groups))
    summary = summary.select(
        "__g", "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        F.sum("__n").over(whole).alias("__total"),
    )
    inside = Window.partitionBy("__g", "__b").orderBy(*order, *ties)
    out = _join_summary(rows, summary, bool(groups), buckets).withColumn(
        name, (F.col("__off") + F.row_number().over(inside) - 1).cast("bigint")
    )
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__g", "__b", "__off", "__total")


def running(
    df: DataFrame,
    values: dict[str, tuple[str, Column]],
    order: Sequence[str],
    groups: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Running aggregates up to and including each row.

    ``values`` maps an output name to ``(kind, expression)`` with kind one of
    sum, count, max, min, previous (the value of the row before) or last (the
    last non-null value so far).
    """
    ordered = F.struct(*[F.col(c) for c in order])
    rows = df
    for i, (_, expr) in enumerate(values.values()):
        rows = rows.withColumn(f"__v{i}", expr)
    count = df.count()
    buckets = buckets or default_buckets(df, count)
    rows = with_buckets(rows, order, groups, None, buckets, count)
    partial, carried, final = [], [], []
    before, _ = _carry(rows, bool(groups))
    inside = Window.partitionBy("__g", "__b").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    for i, (name, (kind, _)) in enumerate(values.items()):
        v, s, c = F.col(f"__v{i}"), f"__s{i}", f"__c{i}"
        if kind in ("sum", "count"):
            fn = F.sum if kind == "sum" else F.count
            partial.append(fn(v).alias(s))
            carried.append(F.sum(s).over(before).alias(c))
            local = fn(v).over(so_far)
            final.append(
                (name, F.when(F.col(c).isNull(), local).otherwise(F.col(c) + F.coalesce(local, F.lit(0))))
            )
        elif kind in ("max", "min"):
            fn, both = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            partial.append(fn(v).alias(s))
            carried.append(fn(s).over(before).alias(c))
            final.append((name, both(F.col(c), fn(v).over(so_far))))
        elif kind == "previous":
            partial.append(F.max_by(F.struct(v.alias("x")), ordered).alias(s))
            carried.append(F.last(s).over(before).alias(c))
            first = F.row_number().over(inside) == 1
            final.append((name, F.when(first, F.col(c)["x"]).otherwise(F.lag(v).over(inside))))
        elif kind == "last":
            partial.append(F.max_by(v, F.when(v.isNotNull(), ordered)).alias(s))
            carried.append(F.last(s, ignorenulls=True).over(before).alias(c))
            final.append((name, F.coalesce(F.last(v, ignorenulls=True).over(so_far), F.col(c))))
        else:
            raise ValueError(f"unknown running aggregate {kind!r}")
    summary = rows.groupBy("__g", "__b").agg(*partial).select("__g", "__b", *carried)
    out = _join_summary(rows, summary, bool(groups), buckets)
    out = out.select("*", *[expr.alias(name) for name, expr in final])
    drop = ["__g", "__b"] + [f"__{k}{i}" for i in range(len(values)) for k in ("v", "c")]
    return out.drop(*drop)


#: Steps of one group that are folded together.
BLOCK = 512


def _compose(steps: Column) -> Column:
    """Fold ``y -> a*y + b`` steps into one (a, b)."""
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(
        steps, start,
        lambda acc, r: F.struct((acc["a"] * r["a"]).alias("a"), (acc["b"] * r["a"] + r["b"]).alias("b")),
    )


def _states(a: Column, b: Column, carry: Column) -> Column:
    """All states of blocks of steps from their ``carry``; the blocks of a batch
    advance together, one step at a time."""

    @F.arrow_udf("array<double>")
    def scan(a: pa.Array, b: pa.Array, carry: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(a).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        first = ends - sizes
        factor, gain = (x.flatten().to_numpy(zero_copy_only=False) for x in (a, b))
        y = carry.to_numpy(zero_copy_only=False).astype(float)
        out = np.empty(len(factor))
        alive = np.arange(len(sizes))
        for k in range(int(sizes.max()) if len(sizes) else 0):
            alive = alive[sizes[alive] > k]
            at = first[alive] + k
            y[alive] = factor[at] * y[alive] + gain[at]
            out[at] = y[alive]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))

    return scan(a, b, carry)


def _carries(blocks: DataFrame, group: str, steps: int) -> DataFrame:
    """(group, blk, carry): the state before each block. ``blocks`` has one composed
    step (a, b) a block; they are folded in blocks again, as often as ``steps``, the
    most steps of a group, asks for."""
    upper = blocks.withColumn("__up", F.floor(F.col("blk") / BLOCK)).groupBy(group, "__up").agg(
        F.sort_array(F.collect_list(F.struct("blk", "a", "b"))).alias("rows"))
    if steps > BLOCK:
        composed = upper.select(group, F.col("__up").alias("blk"), _compose(F.col("rows")).alias("ab")).select(
            group, "blk", "ab.a", "ab.b")
        before = _carries(composed, group, -(-steps // BLOCK)).select(group, F.col("blk").alias("__up"), "carry")
        upper = upper.join(before, [group, "__up"])
    else:
        upper = upper.withColumn("carry", F.lit(0.0))
    states = _states(F.col("rows.a"), F.col("rows.b"), F.col("carry"))
    # the state before a block is the one after the block before it
    shifted = F.concat(F.array(F.col("carry")), F.slice(states, F.lit(1), F.size("rows") - 1))
    pairs = upper.select(group, F.arrays_zip(F.col("rows.blk").alias("blk"), shifted.alias("carry")).alias("z"))
    return pairs.select(group, F.explode("z").alias("z")).select(group, "z.blk", "z.carry")


def linear_recurrence(
    df: DataFrame,
    decay: Column,
    gain: Column,
    order: Sequence[str],
    groups: Sequence[str] = (),
    name: str = "state",
) -> DataFrame:
    """``y = decay * y_before + gain`` along ``order``; the expressions may use
    ``pos``, the position in the group.

    Steps compose, so a block of 512 of them is one step for the blocks above, and
    these are folded in blocks again until one is left, whatever the group's size: no
    array holds more than 512 entries. Rows travel once, to their block; above it only
    (a, b) pairs do.
    """
    cols = df.columns
    rows = df.count()
    ranked = positions(df, order, groups, name="pos")
    steps = ranked.select(
        F.struct(*[F.col(g) for g in groups]).alias("g") if groups else F.lit(0).alias("g"),
        F.floor(F.col("pos") / BLOCK).alias("blk"),
        F.struct(F.col("pos").alias("p"), decay.cast("double").alias("a"), gain.cast("double").alias("b"),
                 F.struct(*[F.col(c) for c in cols]).alias("row")).alias("s"),
    )
    blocks = steps.groupBy("g", "blk").agg(F.array_sort(
        F.collect_list("s"), lambda x, y: (x["p"] - y["p"]).cast("int")).alias("rows"))
    composed = blocks.select("g", "blk", _compose(F.col("rows")).alias("ab")).select("g", "blk", "ab.a", "ab.b")
    carried = blocks.join(_carries(composed, "g", -(-rows // BLOCK)), ["g", "blk"])
    states = _states(F.col("rows.a"), F.col("rows.b"), F.col("carry"))
    out = carried.select(F.explode(F.arrays_zip("rows", states.alias("y"))).alias("z"))
    return out.select("z.rows.row.*", F.col("z.rows.p").alias("pos"), F.col("z.y").alias(name))
