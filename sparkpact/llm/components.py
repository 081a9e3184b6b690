"""Connected components of an edge table: by union-find in one task while the graph is small, else by alternating
large-star and small-star rounds. Both give the same rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, give_back, released

#: Edges that one task joins: some 75 MB and a second at most, where each round would deal the table out several times.
SMALL_GRAPH = 100_000


def _smallest(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """u, v -> each pair with the smallest node around u (u itself included).

    The smallest nodes are written: a join of two tables that both are read and dealt for it is one that Spark splits
    where a hub has many pairs, while an aggregate that stands right below the join keeps it from that.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(scratch.write(least, name).hint("merge"), "u")


def _joined(batches):
    """node, component of the whole graph (u, v)."""
    held = list(batches)
    if not held:
        return
    whole = pa.Table.from_batches(held)
    n, kind = whole.num_rows, whole.schema.field(0).type
    nodes, at = np.unique(np.concatenate([whole.column(k).to_numpy() for k in range(2)]), return_inverse=True)
    at, parent = at.tolist(), list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[:n], at[n:]):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)  # nodes are sorted, so the root is the smallest
    root = nodes[[find(x) for x in parent]] if n else nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(root, kind)], ["node", "component"])


def components(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60, small: int = SMALL_GRAPH) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (columns a, b; a row a link).

    A graph of ``small`` different edges or fewer is joined in one task. In a larger one each round is written to the
    shared folder, so lineage stays short. Groups are combined in each task first; the joins that spread a hub's label
    are such as Spark splits when skewed.
    """
    current = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    if current.count() <= small:
        kind = current.schema["u"].dataType.simpleString()
        return current.coalesce(1).mapInArrow(released(_joined), f"node {kind}, component {kind}")
    before = None
    for i in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both, scratch, f"{name}-least").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low.hint("merge"), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = scratch.write(small, f"{name}-{i + 1}")
        scratch.drop(f"{name}-{i}") if i else None
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        current = new
        give_back(scratch.spark)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
