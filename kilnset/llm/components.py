"""Connected components of an edge table, by large-star and small-star steps.

Every step is an aggregate to the smallest neighbour of each node and a join
with it, so a node with a third of all edges is combined before the shuffle and
its side of the join is split by adaptive execution. Labels only shrink; the
loop ends when a step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnset.llm.scratch import Scratch


def _smallest(pairs: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has an edge to another node;
    the component is the smallest node id reachable. Edges with a null end are
    no edges; repeated edges and self loops are allowed."""
    scratch = Scratch(edges.sparkSession, "components")
    bigger, smaller = F.greatest(a, b), F.least(a, b)
    now = scratch.write(edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(
        bigger.alias("u"), smaller.alias("v")).distinct())
    seen = _digest(now)
    while True:
        # large star: neighbours above a node move to the smallest of all
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.where("u <> v").distinct())
        # small star: neighbours below a node, and the node, move to the smallest of them
        least = _smallest(large)
        moved = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = scratch.write(moved.where("u <> v").distinct())
        digest = _digest(after)
        scratch.drop(now, large)
        now = after
        if digest == seen:
            break
        seen = digest
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def forest(size: int, left, right):
    """Indices of the edges (left, right) of a spanning forest of 0 .. size-1:
    a block with many links passes on fewer than it has members."""
    parent = list(range(size))
    kept = []
    for i, (x, y) in enumerate(zip(left.tolist(), right.tolist())):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return kept
