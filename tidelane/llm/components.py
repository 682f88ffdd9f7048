"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, Stage, lean


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """u, v, m: each directed pair with the least number among u and its neighbours. A hot u is dealt into sub-groups."""
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("u", "s").agg(F.min("v").alias("p"))
    least = part.groupBy("u").agg(F.least(F.col("u"), F.min("p")).alias("m"))
    routed = part.select("u", "s").join(least, "u")
    return salted.join(routed, ["u", "s"]).select("u", "v", "m")


@lean
def _contract(batches):
    """A task's links, joined up by themselves: each node with the least number that it reaches there. As many links as nodes, or fewer."""
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    u, v = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while True:  # hook every root to the least root that it is linked with, then shorten all paths
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        if (low == high).all():
            break
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
    below = up != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[up][below])], ["u", "v"])


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: each v is then its component's least number."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
    inner = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return not twice.union(inner).limit(1).count()


def components(edges: DataFrame, stage: Stage, name: str = "cc") -> DataFrame:
    """node, component: for every node of edges (u, v), numbers without null, the least number that it reaches.
    An edge from a node to itself is none; without edges the result is empty.

    Each task joins up the links that it holds, which leaves at most a link a node. Until all links are stars, a large-star and a
    small-star step follow, and tasks join up their links again. Tables are written to the shared folder, so lost executors cost one step.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = lambda e: e.distinct().mapInArrow(_contract, "u long, v long")
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    now, step = stage.write(joined(ordered), f"{name}0", few=True), 0
    while not _is_forest_of_stars(now):
        # large star: every larger neighbour of u goes to the least of u's neighbourhood
        large = _least_neighbour(both(now.distinct())).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage.write(joined(large), f"{name}{step}l", few=True)
        # small star: u and its smaller neighbours go to the least of them
        small = _least_neighbour(large.distinct())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u != v")
        now = stage.write(joined(small), f"{name}{step + 1}", few=True)
        stage.drop(f"{name}{step}", f"{name}{step}l")
        step += 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
