"""Supporting operators: geometry of contacts, lookups, ragged arrays, densification, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .units import merge_groups


def contact_pitch(contacts: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    """O-SUP-02: keys, pitch: median gap between distinct coordinates; a probe's contacts are a bounded table."""
    rows = contacts.select(*keys, axis).distinct()
    gap = F.col(axis) - F.lag(axis).over(Window.partitionBy(*keys).orderBy(axis))
    return rows.withColumn("_g", gap).groupBy(*keys).agg(F.median("_g").alias("pitch"))


def distance_matrix(contacts: DataFrame, keys: list[str]) -> DataFrame:
    """O-SUP-02: keys, ch, other, distance of all pairs of a probe's contacts."""
    b = contacts.select(*keys, F.col("ch").alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    return contacts.select(*keys, "ch", "x", "y").join(b, keys).select(*keys, "ch", "other", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")).alias("distance"))


def shank_components(contacts: DataFrame, keys: list[str], within: float) -> DataFrame:
    """O-SUP-01: contacts with `component`: the least channel reachable by steps of at most `within`."""
    edges = distance_matrix(contacts, keys).filter((F.col("distance") <= within) & (F.col("ch") < F.col("other")))
    groups = merge_groups(edges, "ch", "other")
    return contacts.join(groups.select(F.col("node").alias("ch"), F.col("group").alias("_g")), "ch", "left").withColumn("component", F.coalesce("_g", "ch")).drop("_g")


def gathered_features(features: DataFrame, spike_id: str, ch: str, values: str, channels: list, width: int) -> DataFrame:
    """O-SUP-03: spike_id, gathered: the values of each listed channel in order, zeros where a spike has none."""
    per = features.filter(F.col(ch).isin(channels)).groupBy(spike_id).agg(F.map_from_entries(F.collect_list(F.struct(ch, values))).alias("_m"))
    empty = F.array_repeat(F.lit(0.0), width)
    parts = [F.coalesce(F.element_at("_m", F.lit(c)), empty) for c in channels]
    return per.select(spike_id, F.flatten(F.array(*parts)).alias("gathered"))


def tree_leaves(tree: DataFrame, depth: int = 64) -> DataFrame:
    """O-SUP-05: parent, leaf: all leaves under each inner node of a binary tree (left, right, parent), by repeated self-joins that double the depth reached. Trees are bounded by the number of clusters."""
    child = tree.select("parent", F.explode(F.array("left", "right")).alias("node"))
    inner = tree.select(F.col("parent").alias("node"))
    reach, level = child, 1
    while level < depth:
        grown = reach.join(reach.select(F.col("parent").alias("node"), F.col("node").alias("_n")), "node").select("parent", F.col("_n").alias("node")).union(reach).distinct()
        if grown.count() == reach.count():
            break
        reach, level = grown, level * 2
    return reach.join(inner, "node", "left_anti").select("parent", F.col("node").alias("leaf"))


def pruned_tree(tree: DataFrame, roots: list[int]) -> DataFrame:
    """O-SUP-06: the tree without the subtrees below roots."""
    under = tree_descendants(tree).filter(F.col("parent").isin(roots)).select(F.col("node").alias("parent")).union(tree.filter(F.col("parent").isin(roots)).select("parent")).distinct()
    return tree.join(under, "parent", "left_anti")


def tree_descendants(tree: DataFrame) -> DataFrame:
    """parent, node: everything under each inner node."""
    reach = tree.select("parent", F.explode(F.array("left", "right")).alias("node"))
    while True:
        grown = reach.join(reach.select(F.col("parent").alias("node"), F.col("node").alias("_n")), "node").select("parent", F.col("_n").alias("node")).union(reach).distinct()
        if grown.count() == reach.count():
            return grown
        reach = grown


def l2_normalised(rows: DataFrame, vector: str) -> DataFrame:
    """O-SUP-07: the vector over its length; zeros stay zeros."""
    x = F.col(vector).cast("array<double>")
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumn(vector, F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x))


def settings_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """O-SUP-09: key, a, b where two tables (key, value) differ; a missing key counts as null."""
    both = a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key", "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b")))


def first_existing(candidates: DataFrame, keys: list[str], rank: str, exists: str) -> DataFrame:
    """O-SUP-13, O-SRC-15/16: of each key the existing candidate with the least rank."""
    return candidates.filter(exists).groupBy(*keys).agg(F.min_by(F.struct(*[c for c in candidates.columns if c not in (*keys, exists)]), rank).alias("_f")).select(*keys, "_f.*")


def one_based(rows: DataFrame, column: str) -> DataFrame:
    """O-SUP-14: an array of 0-based channels as 1-based, missing ones dropped."""
    return rows.withColumn(column, F.transform(F.filter(column, lambda x: x.isNotNull()), lambda x: x + 1))


def densified(rows: DataFrame, index: str, keys: list[str]) -> DataFrame:
    """O-SUP-15: keys, index from 1 to the greatest, other columns null where a number is missing."""
    top = rows.groupBy(*keys).agg(F.max(index).alias("_t")) if keys else rows.agg(F.max(index).alias("_t"))
    grid = top.filter("_t >= 1").withColumn(index, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_t").cast("long")))).drop("_t")
    return grid.join(rows, [*keys, index], "left")


def primary_name(names: DataFrame, wanted: str) -> DataFrame:
    """O-SUP-16: one row of names (position 1-based, name): the exact match, else one in any case, else the position that `wanted` says."""
    rank = F.when(F.col("name") == wanted, 0).when(F.lower("name") == wanted.lower(), 1).when(F.col("position").cast("string") == wanted, 2)
    return names.withColumn("_r", rank).filter("_r IS NOT NULL").orderBy("_r", "position").limit(1).drop("_r")


def interval_ends(points: DataFrame, spans: DataFrame, keys: list[str], t: str, span_id: str, width) -> DataFrame:
    """O-SUP-24: span_id, first, last, n of the points inside each interval (ends closed)."""
    from .ordered import range_join

    hits = range_join(points, spans, keys, t, "start", "stop", width)
    return hits.groupBy(*keys, span_id).agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("n"))


def lineage(stages: list[tuple[str, DataFrame]], spike_id: str, cluster: str) -> DataFrame:
    """O-SUP-08: stage, spike_id, cluster of every stage's assignment."""
    out = None
    for name, df in stages:
        rows = df.select(F.lit(name).alias("stage"), spike_id, cluster)
        out = rows if out is None else out.unionByName(rows)
    return out


def pivot_map(contacts: DataFrame, shank: str, label: str, shanks: list) -> DataFrame:
    """O-SNK-13: position, one column a shank: channel labels by their place in the shank."""
    place = F.row_number().over(Window.partitionBy(shank).orderBy("ch"))  # a shank's contacts: bounded
    return contacts.withColumn("position", place.cast("long")).groupBy("position").pivot(shank, shanks).agg(F.first(label))


def unpivot_map(wide: DataFrame, shanks: list[str]) -> DataFrame:
    """O-SNK-14: position, shank, label: the inverse, blanks dropped."""
    return wide.unpivot(["position"], shanks, "shank", "label").filter("label IS NOT NULL AND trim(label) != ''")


def outer_update(stored: DataFrame, fresh: DataFrame, key: str, value: str) -> DataFrame:
    """Fresh values over stored ones, by key."""
    both = stored.select(key, F.col(value).alias("_s")).join(fresh.select(key, F.col(value).alias("_f")), key, "full")
    return both.select(key, F.coalesce("_f", "_s").alias(value))
