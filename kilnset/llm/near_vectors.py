"""Embedding near-dedup: Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised. Each table quantises ``functions`` random Gaussian
projections into cells of ``width``; vectors with the same cells share a
bucket. Equal vectors are one class first, so copies never meet in a bucket.
Members of a bucket are compared exactly, in double precision, block against
block. A pair is counted in the first table where its members meet, so link
counts are right without a list of pairs: a block passes on counts of links per
vector and a spanning forest of its links.

For cosine c the distance is sqrt(2 - 2c). At cosine 0.9, width 2 and 10
functions, one table catches a pair with probability 0.14 and 40 tables with
0.997; nearer pairs are caught more often, unrelated ones (cosine 0) meet with
probability 0.0007 a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnset.llm.components import components, forest
from kilnset.llm.groups import block_pairs, by_key, runs
from kilnset.llm.scratch import Scratch
from kilnset.llm.words import mix

TABLES = 40
FUNCTIONS = 10
WIDTH = 2.0
#: Members of a bucket that are compared in one matrix product.
BLOCK = 512


def projections(dimension: int, tables: int, functions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dimension])
    return rng.standard_normal((dimension, tables * functions)), rng.random(tables * functions)


def bucket_ids(unit: np.ndarray, tables: int, functions: int, width: float, seed: int) -> np.ndarray:
    """Bucket of each vector in each table (n x tables, uint64)."""
    direction, shift = projections(unit.shape[1], tables, functions, seed)
    cells = np.floor(unit @ direction / width + shift).astype(np.int64).astype(np.uint64)
    cells = cells.reshape(len(unit), tables, functions)
    out = np.zeros((len(unit), tables), dtype=np.uint64)
    for j in range(functions):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return out


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9,
                 tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, seed: int = 0) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing and are their own component; vectors of different lengths
    never link. Rows with a null key link with nothing and have a null
    component; rows that repeat a key are judged row by row. An empty table gives
    an empty one.
    """
    scratch = Scratch(rows.sparkSession, "near-vectors")
    kind = rows.schema[vector].dataType
    flat = kind if kind.simpleString() == "array<float>" else "array<double>"
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(flat).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # adding 0 turns -0.0 into 0.0, so that equal vectors have equal texts
    base = base.select("id", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0).cast(x_type(flat)))).alias("v"))
    base = scratch.write(base.withColumn("cls", F.md5(F.array_join(F.col("v").cast("array<string>"), ","))))
    classes = scratch.write(base.where("cls is not null").groupBy("cls").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for size in np.unique(lengths):
                some = batch.take(pa.array(np.flatnonzero(lengths == size)))
                n = len(some)
                ids = bucket_ids(_unit(some.column(1), size), tables, functions, width, seed)
                table = np.arange(tables, dtype=np.uint64)
                bucket = mix(ids + table * np.uint64(0xD1B54A32D192ED03) + np.uint64(size)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.ravel()), pa.array(np.tile(table.astype(np.int32), n)),
                     some.column(0).take(pa.array(np.repeat(np.arange(n), tables)))], ["bucket", "tab", "cls"])

    keyed = scratch.write(classes.select("cls", "v").mapInArrow(hash_rows, "bucket long, tab int, cls string"))
    sizes = keyed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("n"))
    members = keyed.join(sizes.where("n > 1").drop("n"), "bucket")
    members = members.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    members = block_pairs(members, "blocks", "block").drop("blocks").join(classes, "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            found = _links(group, cosine, tables, functions, width, seed)
            if found is not None:
                yield found

    found = by_key(members, "bucket", "i", "j").select("bucket", "i", "j", "tab", "cls", "block", "copies", "rep", "v")
    found = scratch.write(found.mapInArrow(compare, "cls string, n long, a long, b long"))
    counts = found.where("cls is not null").groupBy("cls").agg(F.sum("n").alias("n"))
    labels = components(found.where("cls is null"))
    scratch.drop(keyed)
    named = classes.select("cls", "rep", "copies").join(counts, "cls", "left").join(
        labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(
        "cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    out = base.join(named, "cls", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def x_type(array_type) -> str:
    return (array_type if isinstance(array_type, str) else array_type.simpleString())[6:-1]


def _unit(column, size: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    raw = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _links(group: pa.Table, cosine, tables, functions, width, seed) -> pa.RecordBatch | None:
    """Links of one block pair that no earlier table has."""
    i, j, tab = (int(group[c][0].as_py()) for c in ("i", "j", "tab"))
    column = group["v"].combine_chunks()
    lengths = np.asarray(column.value_lengths())
    if len(lengths) < 2 or lengths.min() != lengths.max():
        return None
    unit, block = _unit(column, int(lengths[0])), group["block"].to_numpy()
    if i == j:
        x, y = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
    else:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        x, y = np.nonzero(unit[left] @ unit[right].T >= cosine)
        x, y = left[x], right[y]
    if not len(x):
        return None
    some = np.unique(np.concatenate([x, y]))
    ids = np.zeros((len(unit), tables), dtype=np.uint64)
    ids[some] = bucket_ids(unit[some], tables, functions, width, seed)
    first = np.zeros(len(x), dtype=bool)
    for a in range(0, len(x), 1 << 16):
        part = slice(a, a + (1 << 16))
        first[part] = (ids[x[part]] == ids[y[part]]).argmax(axis=1) == tab
    x, y = x[first], y[first]
    if not len(x):
        return None
    copies, rep = group["copies"].to_numpy(), group["rep"].to_numpy()
    links = np.bincount(x, weights=copies[y], minlength=len(unit)) + np.bincount(
        y, weights=copies[x], minlength=len(unit))
    at = np.flatnonzero(links)
    kept = forest(len(unit), x, y)
    none = len(kept)
    cls = pa.concat_arrays([group["cls"].combine_chunks().take(pa.array(at)), pa.nulls(none, pa.string())])
    pad = np.zeros(len(at), dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [cls, pa.array(np.concatenate([links[at].astype(np.int64), np.zeros(none, dtype=np.int64)])),
         pa.array(np.concatenate([pad, rep[x[kept]]])), pa.array(np.concatenate([pad, rep[y[kept]]]))],
        ["cls", "n", "a", "b"])
