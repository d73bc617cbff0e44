"""Trie of conversation prefixes by ROLLUP over positional turn ids.

Conversations are rebuilt (some share their first turns with the head of their
hundred), and every distinct sequence of first turns is a node. Turns become
positional columns, ``WIDTH`` to a block: one ``GROUP BY block, prior, ROLLUP (t1,
.., tn)`` gives all prefixes of all blocks together, ``grouping_id`` tells how
deep a row is. Blocks beyond the first are keyed by the node that the blocks
before them end in, which a running sum over blocks names, so no loop follows the
length of a conversation. Sums over subtrees come from a second ROLLUP over the
nodes themselves: a prefix sums what lies behind it in its block, and what lies
in later blocks is carried along the smallest member's blocks as a running sum
from their end.

A node's name is the sum, over its turns, of 120 bits of a digest of (position,
role, text): equal for equal sequences only, and the name of the parent is a
subtraction away.

Hot prefixes: ROLLUP combines before the shuffle; joins are on nodes, and that
with parents, where a node may have many children, is one that adaptive
execution can split. A conversation of any length is numbered in ranges
(``operators.ranking``). Member ids of a node are hashed in runs of ``RUN``
ids; a digest is one stream by nature, so nodes with several runs stream them
through a task, a run as one row, without holding them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnset.llm.scratch import Scratch
from kilnset.operators.ranking import positions, running

#: Turn columns of a block.
WIDTH = 8
#: Conversations of a family share the first turns of its first one.
FAMILY = 100
SHARED = 6
#: Member ids of one digest run: at most so many rows are collected.
RUN = 4096
#: Characters of a turn's text that cut ranges; ties are settled by all of it.
HEAD = 64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
KEY = "decimal(38,0)"


def _digest_part(place, turn, half: int):
    """60 bits of the digest of a turn at its place."""
    hexed = F.md5(F.concat_ws(":", place.cast("string"), turn).cast("binary"))
    return F.conv(F.substring(hexed, 1 + 15 * half, 15), 16, 10).cast(KEY)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (0-based), n, turn id. A turn id is the digest of role and
    text with the number of code points of the text behind it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        text.alias("text")).withColumn("head", F.substring("text", 1, HEAD))
    placed = positions(rows, ["turn", "role", "head"], ["conv_id"], total="n", ties=["text"])
    turn = F.concat(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")),
                    F.lit(":"), F.length("text").cast("string"))
    return placed.select("conv_id", "pos", "n", turn.alias("tid"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, tid) of the rebuilt conversations, and the ids of those
    without any turn."""
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED))
    first = turns.where("pos = 0").select("conv_id", "n")
    convs = first.select("conv_id", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), "n")
    heads = turns.where(F.col("pos") < SHARED).select(F.col("conv_id").alias("family"), "pos", "tid", F.col("n").alias("n_head"))
    prefix = convs.join(heads, "family").where("pos < h")
    sizes = convs.join(first.select(F.col("conv_id").alias("family"), F.col("n").alias("n_head")), "family", "left").select(
        "conv_id", "h", "n", F.least("h", F.coalesce("n_head", F.lit(0))).alias("n_shared"))
    own = turns.select("conv_id", "pos", "tid").join(sizes.select("conv_id", "h", "n_shared"), "conv_id").where("pos >= h")
    whole = prefix.select("conv_id", "pos", "tid").unionByName(
        own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_shared")).alias("pos"), "tid"))
    bare = sizes.where("n_shared = 0 and n <= h").select("conv_id")
    return whole, bare


def blocked(turns: DataFrame, bare: DataFrame, width: int) -> DataFrame:
    """conv_id, blk, t1 .. tn and the sums x0, x1 of the block's turn digests."""
    place = F.col("pos") % width
    cells = [F.max(F.when(place == i, F.col("tid"))).alias(f"t{i + 1}") for i in range(width)]
    sums = [F.sum(_digest_part(F.col("pos"), F.col("tid"), half)).cast(KEY).alias(f"x{half}") for half in (0, 1)]
    full = turns.withColumn("blk", F.floor(F.col("pos") / width)).groupBy("conv_id", "blk").agg(*cells, *sums)
    none = bare.select("conv_id", F.lit(0).cast("long").alias("blk"),
                       *[F.lit(None).cast("string").alias(f"t{i + 1}") for i in range(width)],
                       F.lit(0).cast(KEY).alias("x0"), F.lit(0).cast(KEY).alias("x1"))
    return full.unionByName(none)


def rolled(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """``aggregates`` of every prefix in every block: blk, prior name (p0, p1),
    d (turns of the block), t1 .. tn, depth, last turn, name (k0, k1)."""
    cells = ", ".join(f"t{i + 1}" for i in range(width))
    out = rows.sparkSession.sql(
        f"SELECT blk, p0, p1, {cells}, {width} - bit_count(grouping_id()) AS d, {aggregates} "
        f"FROM {{rows}} GROUP BY blk, p0, p1, ROLLUP ({cells})", rows=rows)
    columns = [F.col(f"t{i + 1}") for i in range(width)]
    last = F.get(F.array(*columns), F.col("d") - 1)
    # a null turn is the end of a shorter conversation, not a node
    out = out.withColumn("last", last).where("d > 0 and last is not null or d = 0 and blk = 0")
    place = F.col("blk") * width
    for half in (0, 1):
        parts = [F.when(F.col("d") > i, _digest_part(place + i, c, half)).otherwise(0) for i, c in enumerate(columns)]
        total = F.col(f"p{half}")
        for part in parts:
            total = (total + part).cast(KEY)
        out = out.withColumn(f"k{half}", total)
    return out.withColumn("depth", place + F.col("d"))


def _stream_digests(batches):
    """SHA-256 of the runs of a key, which come in order."""
    key, state = None, None
    keys, digests = [], []
    for batch in batches:
        for k0, k1, ids in zip(batch["k0"], batch["k1"], batch["ids"]):
            now = (k0.as_py(), k1.as_py())
            if now != key:
                if key is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
        if len(keys) >= 1000:
            yield _digest_batch(keys, digests)
            keys, digests = [], []
    if key is not None:
        keys.append(key)
        digests.append(state.hexdigest())
    if keys:
        yield _digest_batch(keys, digests)


def _digest_batch(keys, digests):
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], kind), pa.array([k[1] for k in keys], kind), pa.array(digests)], ["k0", "k1", "ends_sha256"])


def ends(blocks: DataFrame, run: int) -> DataFrame:
    """k0, k1, ends_sha256 of the nodes in which conversations end."""
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct("s0", "s1"), "blk").alias("k")).select(
        "conv_id", F.col("k.s0").alias("k0"), F.col("k.s1").alias("k1"))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    runs = last.withColumn("run", F.floor(F.col("conv_id") / run)).groupBy("k0", "k1", "run").agg(ids)
    scratch = Scratch(blocks.sparkSession, "trie-ends")
    runs = scratch.write(runs)
    count = runs.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n_runs"), F.min_by("ids", "run").alias("ids"))
    one = count.where("n_runs = 1").select("k0", "k1", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = runs.join(count.where("n_runs > 1").select("k0", "k1"), ["k0", "k1"], "left_semi")
    streamed = many.select("k0", "k1", "run", "ids").repartition("k0", "k1").sortWithinPartitions("k0", "k1", "run").mapInArrow(
        _stream_digests, f"k0 {KEY}, k1 {KEY}, ends_sha256 string")
    return one.unionByName(streamed)


def prefix_trie(conversations: DataFrame, width: int = WIDTH, run: int = RUN) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (null at
    the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role and text; equal rows are
    turns of their own. A null role or text is empty. Rows without a conv_id
    belong to no conversation and are left out. A conversation without a turn
    after rebuilding is a member of the root. An empty table has no node, not
    even a root. Other columns do not matter.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.write(numbered(conversations))
    whole, bare = rebuilt(turns)
    blocks = scratch.write(blocked(whole, bare, width))
    sums = {f"s{half}": ("sum", F.col(f"x{half}")) for half in (0, 1)}
    blocks = running(blocks, sums, ["blk"], ["conv_id"])
    blocks = scratch.write(blocks.select(
        "conv_id", "blk", *[f"t{i + 1}" for i in range(width)],
        *[F.col(f"s{h}").cast(KEY).alias(f"s{h}") for h in (0, 1)],
        *[(F.col(f"s{h}") - F.col(f"x{h}")).cast(KEY).alias(f"p{h}") for h in (0, 1)]))

    cells = [f"t{i + 1}" for i in range(width)]
    nodes = rolled(blocks, width, "min(conv_id) AS conv_id, count(*) AS n_convs")
    place = F.col("depth") - 1
    parent = [F.when(F.col("depth") > 0, (F.col(f"k{h}") - _digest_part(place, F.col("last"), h)).cast(KEY)).alias(f"u{h}")
              for h in (0, 1)]
    size = F.coalesce(F.substring_index("last", ":", -1).cast("long"), F.lit(0))
    nodes = scratch.write(nodes.select(
        "blk", "p0", "p1", *cells, "k0", "k1", *parent, "depth", "conv_id", "n_convs",
        ((F.col("n_convs") - 1) * size).alias("saved")))

    children = nodes.where("depth > 0").groupBy(F.col("u0").alias("k0"), F.col("u1").alias("k1")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = scratch.write(nodes.join(children, ["k0", "k1"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn(
        "leaf", (F.col("n_children") == 0).cast("long")))

    # what lies in later blocks, along the blocks of conversations with several
    held = nodes.groupBy("conv_id", "blk").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    deep = blocks.where("blk > 0").select("conv_id").distinct()
    long = scratch.write(blocks.join(deep, "conv_id", "left_semi").join(held, ["conv_id", "blk"], "left").withColumn(
        "from_end", -F.col("blk")).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("leaf", "saved")}))
    behind = running(long, {f"r_{c}": ("sum", F.col(c)) for c in ("leaf", "saved")}, ["from_end"], ["conv_id"])
    kept = ["blk", "p0", "p1", *cells]
    carried = behind.select(*kept, *[(F.col(f"r_{c}") - F.col(c)).alias(c) for c in ("leaf", "saved")]).where(
        "leaf > 0 or saved > 0")
    sums = rolled(nodes.select(*kept, "leaf", "saved").unionByName(carried), width,
                  "sum(leaf) AS n_leaves, sum(saved) AS saved_tokens").select("k0", "k1", "n_leaves", "saved_tokens")

    named = nodes.select(F.col("k0").alias("u0"), F.col("k1").alias("u1"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, ["k0", "k1"]).join(ends(blocks, run), ["k0", "k1"], "left").join(named, ["u0", "u1"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
