"""N-gram Jaccard join with vertical partitioning.

Documents are sets of distinct word shingles. Two link when
``100 * intersection >= percent * union``. Shingles have one global order: those
that no other document holds first, then by hash. It is cut into fragments, the
overlap of a pair is counted in each fragment on its own, and the partial counts
are summed per pair.

What is not counted at all: shingles of one document only (they are known after
one exchange of packed hashes) and documents that have too few others left to
reach the threshold. Equal sets are one class with one representative. Candidates
share a shingle in their prefixes, the first ``n - ceil(t n) + 1`` shingles. In
each such list the document with the largest share of common shingles leads, and
everyone is compared with the leader, so a list of any length gives as many
pairs as it has members. Members that this leaves in different components are
compared block against block: by their prefixes first, and what can still link
in tasks that add the fragments' partial counts up in a matrix and pass on a
spanning forest of the links they find. Every candidate
pair shares a leader, so none is lost; links inside a component aren't needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnset.llm.components import components, forest
from kilnset.llm.groups import block_pairs, by_key, runs
from kilnset.llm.repeats import (
    ENTRY_SCHEMA, LOCAL_BYTES, NO_ID, emit_sets, exchange_sets, named, range_count, split_binary)
from kilnset.llm.scratch import Scratch
from kilnset.llm.words import Words, as_strings, mix, slices, window_hashes

SHINGLE = 5
PERCENT = 80
#: Fragments of the global order in the leader step, columns of a fragment and
#: members of a block in the block step.
FRAGMENTS = 8
COLUMNS = 4096
BLOCK = 512
#: Text bytes behind a hash range: a document gets a row from each, so fewer are cheaper.
RANGE_BYTES = 14 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as (hash, document), sorted by document, and the size
    of each set. A shorter text is one shingle, an empty one has none."""
    found = window_hashes(words.hashes(), size)
    inside = np.flatnonzero(words.doc[:len(found)] == words.doc[size - 1:]) if len(found) else np.zeros(0, int)
    keys, doc = found[inside], words.doc[inside]
    few = np.flatnonzero((words.n > 0) & (words.n < size))
    if len(few):
        hashes = words.hashes()
        whole = np.array([_fold(hashes[words.first[i]:words.first[i + 1]]) for i in few], dtype=np.uint64)
        keys, doc = np.concatenate([keys, whole]), np.concatenate([doc, few.astype(doc.dtype)])
    order = np.argsort(mix(keys + doc.astype(np.uint64) * _ODD), kind="stable")
    k, d = keys[order], doc[order]
    fresh = np.ones(len(k), dtype=bool)
    fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.sort(order[fresh])
    at = at[np.argsort(doc[at], kind="stable")]
    return keys[at], doc[at], np.bincount(doc[at], minlength=len(words.n))


def _prints(keys: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each whole set, whatever the order of its shingles."""
    ends = np.concatenate([[np.uint64(0)], np.cumsum(mix(keys + np.uint64(7)), dtype=np.uint64)])
    last = np.cumsum(n)
    return mix(ends[last] - ends[last - n] + n.astype(np.uint64) * _ODD)


def _fold(hashes: np.ndarray) -> int:
    out = len(hashes)
    for h in hashes.tolist():
        out = ((out ^ h) * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) % (1 << 64)
    return out


def least_overlap(n, percent: int = PERCENT):
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


def enough(inter, a, b, percent: int = PERCENT):
    """100 * inter >= percent * union, for numbers, arrays or columns."""
    return (100 + percent) * inter >= percent * (a + b)


def _sets(size: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            rank, row, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), as_strings(batch.column(2))
            for a, b in slices(column, LOCAL_BYTES):
                keys, doc, n = shingle_sets(Words(column.slice(a, b - a), lower=True), size)
                yield emit_sets(keys, doc, n, _prints(keys, doc, n), rank[a:b], row[a:b], ranges)

    return run


def _activate(percent: int):
    """Keys sorted and distinct; empty where the document can't link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            keys, counts = split_binary(batch.column(5), np.uint64)
            ends = np.cumsum(counts)
            out, m = [], []
            for i, size in enumerate(n.tolist()):
                some = np.unique(keys[ends[i] - counts[i]:ends[i]])
                if not size or len(some) < least_overlap(size, percent):
                    some = some[:0]
                out.append(some.tobytes())
                m.append(len(some))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(m, pa.int64()), pa.array(out, pa.binary())],
                ["rank", "row", "n", "copies", "cls", "m", "keys"])

    return run


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keys, counts = split_binary(batch.column(4), np.uint64)
            first = np.cumsum(counts) - counts
            size = np.minimum(m, m - least_overlap(n, percent) + 1)
            doc = np.repeat(np.arange(len(n)), size)
            at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(doc))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at].view(np.int64)), *[batch.column(i).take(take) for i in range(4)]],
                ["key", "id", "rank", "n", "m"])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts = split_binary(batch.column(4), np.uint64)
        doc = np.repeat(np.arange(len(counts)), counts)
        fragment = (keys >> np.uint64(61)).astype(np.int64)  # FRAGMENTS = 8
        cell = doc * FRAGMENTS + fragment  # keys are sorted, so cells are runs
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(begin, len(cell)).astype(np.int32)), pa.array(keys.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc[begin])), pa.array(fragment[begin].astype(np.int32)), lists],
            ["id", "fragment", "segment"])


def _heads(percent: int):
    """The prefixes, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            keys, counts = split_binary(batch.column(3), np.uint64)
            size = np.minimum(m, m - least_overlap(n, percent) + 1)
            first = np.cumsum(counts) - counts
            at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["id", "n", "m", "head"])

    return run


def _prefixes_allow(percent: int):
    """Condition on a pair with its leader: see ``_possible``."""
    common = F.size(F.array_intersect("head", "lead_head"))
    # hashes are ordered as unsigned numbers
    flip = lambda c: F.element_at(c, -1).bitwiseXOR(F.lit(-(1 << 63)))
    short = F.when(flip("head") <= flip("lead_head"), F.col("n")).otherwise(F.col("lead_n"))
    least = F.ceil(percent * short / F.lit(100))
    need = F.ceil(percent * (F.col("n") + F.col("lead_n")) / F.lit(100 + percent))
    return (common > 0) & (common + least - 1 >= need)


def _overlaps(keys: np.ndarray, doc: np.ndarray, members: int) -> np.ndarray:
    """Common keys of every two members: partial counts of each fragment of the
    order (so many keys that two members hold), summed per pair."""
    names, place, uses = np.unique(keys, return_inverse=True, return_counts=True)
    column = (np.cumsum(uses > 1) - 1)[place]
    shared = uses[place] > 1
    column, doc = column[shared], doc[shared]
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    total = np.zeros((members, members))
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        part = np.zeros((members, COLUMNS), dtype=np.float32)
        part[doc[a:b], column[a:b] - begin] = 1.0
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def _apart(group: pa.Table, percent: int) -> np.ndarray:
    """Pairs of a block pair that aren't in one component and long enough."""
    i, j = int(group["i"][0].as_py()), int(group["j"][0].as_py())
    n, m, label, block = (group[c].to_numpy() for c in ("n", "m", "component", "block"))
    apart = (label[:, None] != label[None, :]) & enough(np.minimum.outer(m, m), n[:, None], n[None, :], percent)
    return apart & (np.triu(np.ones_like(apart), 1) if i == j else (block == i)[:, None] & (block == j)[None, :])


def _possible(percent: int):
    """Members that can link with another one, judged by prefixes alone: beyond
    its prefix a set has ``least_overlap - 1`` shingles, and the set whose prefix
    ends first has no other common ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            apart = _apart(group, percent)
            if not apart.any():
                continue
            n = group["n"].to_numpy()
            heads = group["head"].combine_chunks()
            keys = np.ascontiguousarray(heads.flatten().to_numpy()).view(np.uint64)
            counts = heads.value_lengths().to_numpy()
            common = _overlaps(keys, np.repeat(np.arange(len(n)), counts), len(n))
            last = keys[np.cumsum(counts) - 1]
            short = np.where(last[:, None] <= last[None, :], n[:, None], n[None, :])
            need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))
            apart &= (common > 0) & (common + least_overlap(short, percent) - 1 >= need)
            some = np.flatnonzero(apart.any(axis=0) | apart.any(axis=1))
            if len(some):
                out = group.take(pa.array(some)).combine_chunks().to_batches()[0]
                yield out.select(["lead", "i", "j", "id", "rank", "n", "m", "component", "block"])

    return run


def _block_links(percent: int):
    """A spanning forest of the links of each block pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            apart, n, rank = _apart(group, percent), group["n"].to_numpy(), group["rank"].to_numpy()
            keys, counts = split_binary(group["keys"], np.uint64)
            inter = _overlaps(keys, np.repeat(np.arange(len(n)), counts), len(n))
            x, y = np.nonzero(apart & enough(inter, n[:, None], n[None, :], percent))
            if len(x):
                kept = forest(len(n), x, y)
                yield pa.RecordBatch.from_arrays([pa.array(rank[x[kept]]), pa.array(rank[y[kept]])], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key
    reachable by links, itself included).

    A to Z is folded to lower case. Null and empty texts have no shingles and
    link with nothing; documents with a null key link with nothing and have a
    null component; rows that share a key are one node; an empty table gives an
    empty one; other columns of ``docs`` are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    source = named(docs, key, text)
    entries = source.mapInArrow(_sets(shingle, range_count(docs, text, RANGE_BYTES)), ENTRY_SCHEMA)
    sets = scratch.write(exchange_sets(entries, scratch).select("rank", "row", "n", "copies", "cls", "keys").mapInArrow(
        _activate(percent), "rank long, row long, n long, copies long, cls long, m long, keys binary"))

    # one class for each set: its smallest id, and the shingles of a member that can link
    classes = scratch.write(sets.where("cls is not null").groupBy("cls").agg(F.min("rank").alias("rep")))
    held = sets.where("m > 0").groupBy("cls").agg(
        F.first("n").alias("n"), F.first("m").alias("m"), F.first("keys").alias("keys"))
    shapes = scratch.write(held.join(classes, "cls").select(
        F.col("cls").alias("id"), F.col("rep").alias("rank"), "n", "m", "keys"))

    prefix = scratch.write(shapes.mapInArrow(_prefixes(percent), "key long, id long, rank long, n long, m long"))
    own = 1.0 - F.col("m") / F.col("n")
    lead = prefix.groupBy("key").agg(
        F.min(F.struct(own.alias("own"), "id", "rank", "n", "m")).alias("lead"), F.count(F.lit(1)).alias("uses"))
    lead = scratch.write(lead.where("uses > 1").select("key", "lead.*").select(
        "key", F.col("id").alias("lead"), F.col("rank").alias("lead_rank"), F.col("n").alias("lead_n"),
        F.col("m").alias("lead_m")))
    pairs = prefix.join(lead, "key").where("id <> lead").drop("key").distinct()
    possible = enough(F.least("m", "lead_m"), F.col("n"), F.col("lead_n"), percent)
    pairs = scratch.write(pairs.withColumn("possible", possible))
    scratch.drop(prefix, lead)

    segments = scratch.write(shapes.mapInArrow(_segments, "id long, fragment int, segment array<long>"))
    heads = shapes.select("id", "n", "m", "keys").mapInArrow(_heads(percent), "id long, n long, m long, head array<long>")
    heads = scratch.write(heads)
    right = segments.withColumnRenamed("id", "lead").withColumnRenamed("segment", "lead_segment")
    near = pairs.where("possible").join(heads.select("id", "head"), "id").join(
        heads.select(F.col("id").alias("lead"), F.col("head").alias("lead_head")), "lead")
    near = near.where(_prefixes_allow(percent)).drop("head", "lead_head")
    partial = near.join(segments, "id").join(right, ["lead", "fragment"])
    partial = partial.withColumn("part", F.size(F.array_intersect("segment", "lead_segment")))
    names = ["lead", "id", "lead_rank", "rank", "lead_n", "n"]
    summed = partial.groupBy(*names).agg(F.sum("part").alias("inter"))
    star = scratch.write(summed.where(enough(F.col("inter"), F.col("n"), F.col("lead_n"), percent)).select(
        F.col("lead_rank").alias("a"), F.col("rank").alias("b")))
    scratch.drop(segments)
    labels = components(star)

    members = pairs.select("lead", "id", "rank").join(labels.withColumnRenamed("node", "rank"), "rank", "left")
    members = scratch.write(members.withColumn("component", F.coalesce("component", "rank")))
    open_ = members.groupBy("lead").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("lo <> hi").select("lead", "blocks")
    blocks = members.join(open_, "lead").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    names = "lead long, i int, j int, id long, rank long, n long, m long, component long, block int"
    blocks = by_key(block_pairs(blocks, "blocks", "block").drop("blocks").join(heads, "id"), "lead", "i", "j")
    blocks = scratch.write(blocks.mapInArrow(_possible(percent), names))
    blocks = by_key(blocks.join(shapes.select("id", "keys"), "id"), "lead", "i", "j")
    rest = scratch.write(blocks.mapInArrow(_block_links(percent), "a long, b long"))
    scratch.drop(members)

    # ids of several rows tie the classes of their sets together
    repeated = sets.groupBy("rank").agg(F.sum("copies").alias("rows")).where(f"rows > 1 and rank <> {NO_ID}")
    ties = sets.where("cls is not null").join(repeated, "rank", "left_semi").join(classes, "cls").select(
        F.col("rank").alias("a"), F.col("rep").alias("b"))
    labels = components(star.unionByName(rest).unionByName(ties)).withColumnRenamed("node", "rep")
    out = sets.select("rank", "n", "copies", "cls").join(classes, "cls", "left")
    out = out.withColumn("rep", F.coalesce("rep", "rank")).join(labels, "rep", "left")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.when(F.col("rank") != NO_ID, F.col("rank")).alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("rank") != NO_ID, F.coalesce("component", "rep")).alias("component_id"))
