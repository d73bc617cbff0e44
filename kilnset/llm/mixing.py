"""Mixing sources to target weights: pivotal dependent rounding.

Every document of a source has the same copy probability, its source's target
over its source's size. The whole part is taken for certain; the fractions are
rounded dependently: documents pass words to each other, in a random direction
that leaves all expectations unchanged, until one of them has a whole number of
copies. The others meet the next document. Blocks of a source are
rounded in parallel, each leaves one fractional document at most, and these meet
again level by level in a reduction tree, so a source's taken words miss its
target by less than one, mostly small, document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnset.llm.scratch import Scratch
from kilnset.operators.ranking import positions

#: Documents rounded by one call, and blocks that meet in one of the next level.
BLOCK_ROWS = 2048
FAN_IN = 256


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target for each source of ``(source, size)``.

    Weights repeat along the sources in code point order, null last. All sources
    share ``share`` of all words; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight until none is above.
    """
    scratch = Scratch(sizes.sparkSession, "mix-targets")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = scratch.write(totals.withColumn("__null", F.col("source").isNull()))
    ranked = positions(totals, ["__null", "source"], name="__rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = scratch.write(ranked.select(
        "source", "source_size", F.get(cycle, (F.col("__rank") % len(weights)).cast("int")).alias("weight")))
    whole = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    bound = F.col("source_size") * most
    while True:
        above = F.col("weight") * level > bound
        spent, rest, n = ranked.agg(
            F.sum(F.when(above, bound).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
            F.sum(above.cast("long"))).first()
        if n is None or n == stopped or not rest:
            break
        stopped, level = n, (whole - spent) / rest
    return ranked.withColumn("target", F.least(F.col("weight") * level, bound))


EPSILON = 1e-9


def _pivot(sizes, parts, rng: np.random.Generator) -> tuple[list[float], int | None]:
    """Rounded fractions of documents sorted by falling size, and the index that
    stays fractional, if any.

    A document meets the next smaller ones until together they can hand it the
    words up to its next copy and take the words of its fraction. Then one draw
    moves these words in one of the two directions, so that it becomes whole and
    no expectation changes; alike documents settle in pairs. Starting with the
    largest, what stays open at the end is small.
    """
    size, part = [float(x) for x in sizes], [float(x) for x in parts]
    n, first = len(size), 0
    draws = iter(rng.random(4 * n + 64).tolist())
    while True:
        while first < n and not 0.0 < part[first] < 1.0:
            first += 1
        if first == n:
            return part, None
        a, p, need, shares = size[first], part[first], 1.0, []
        for j in range(first + 1, n):
            q = part[j]
            if not 0.0 < q < 1.0:
                continue
            w = min(q * size[j] / ((1 - p) * a), (1 - q) * size[j] / (p * a), need)
            shares.append((j, w))
            need -= w
            if need <= EPSILON:
                break
        if not shares:
            return part, first
        draw = next(draws, None)
        up = (rng.random() if draw is None else draw) < p
        moved = (1 - p) * a if up else -p * a
        for j, w in shares:
            part[j] = _settled(part[j] - moved * w / size[j])
        part[first] = _settled(p + moved * (1.0 - need) / a)


def _settled(x: float) -> float:
    return 0.0 if x < EPSILON else 1.0 if x > 1 - EPSILON else x


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """Copies of each document of ``(doc_id, source, size, mark, ...)``.

    ``size`` is the document's words (null: none) and ``mark`` a number that
    tells documents apart beside ``doc_id``. Returns every row once with its
    columns, source_size, target and copies (long). Documents without words get
    no copies; null sources are one source; an empty table stays
    empty; rows alike in every column are rounded one by one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs = docs.withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long"))
    targets = source_targets(docs, weights, share, most)
    chance = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keep = docs.columns
    known = targets.withColumnRenamed("source", "__s")
    rows = docs.join(known, F.col("source").eqNullSafe(F.col("__s"))).withColumn(
        "__whole", F.when(F.col("size") > 0, F.floor(chance)).otherwise(0))
    rows = rows.withColumn("__part", F.when(F.col("size") > 0, chance - F.col("__whole")).otherwise(0.0))
    # blocks follow the words of a source through its share of rows
    per = docs.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("__blocks")).withColumnRenamed(
        "source", "__t")
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("__t")))
    rows = rows.withColumn("__order", F.xxhash64("doc_id", "mark", F.lit(seed)))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(F.col("__order")), F.col("__blocks")))
    rows = rows.select(*keep, "source_size", "target", "__whole", "__part", "__order", "__blocks", "__block")
    schema = T.StructType([*rows.schema.fields, T.StructField("__open", T.BooleanType())])

    def reduce_block(level):
        def run(block: pa.Table) -> pa.Table:
            size, order = block["size"].to_numpy(), block["__order"].to_numpy()
            by = np.lexsort((order, -size))
            rng = np.random.default_rng([seed, level, int(order[by[0]]) % (1 << 63), len(by)])
            part, left = _pivot(size[by], block["__part"].to_numpy()[by], rng)
            block = block.take(pa.array(by))
            block = block.set_column(block.column_names.index("__part"), "__part", pa.array(part, pa.float64()))
            return block.append_column("__open", pa.array(np.arange(len(by)) == (-1 if left is None else left)))

        return run

    done, level = [], 0
    while True:
        out = rows.groupBy("source", "__block").applyInArrow(reduce_block(level), schema)
        out = scratch.write(out)
        done.append(out.where("not __open"))
        rest = out.where("__open").drop("__open")
        blocks = out.agg(F.max("__blocks")).first()[0]
        if not blocks or blocks <= 1:
            break
        # one row of each block is left: the next level is so much smaller
        rows = rest.withColumn("__blocks", F.ceil(F.col("__blocks") / FAN_IN)).withColumn(
            "__block", F.floor(F.col("__block") / FAN_IN))
        level += 1
    last = F.when(F.pmod(F.xxhash64("__order", F.lit("last")), F.lit(1 << 30)) / float(1 << 30) < F.col("__part"), 1.0)
    done.append(rest.withColumn("__part", last.otherwise(0.0)).withColumn("__open", F.lit(True)))
    every = done[0]
    for table in done[1:]:
        every = every.unionByName(table)
    return every.select(*keep, "source_size", "target", (F.col("__whole") + F.col("__part")).cast("long").alias("copies"))
