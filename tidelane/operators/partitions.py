"""Unions, concatenation, grouping of channels, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def concatenate(parts: list[DataFrame], sample: str, lengths: list[int]) -> DataFrame:
    """O-UNI-01: the parts' rows with their sample shifted to the common axis, and epoch (0-based)."""
    starts = [sum(lengths[:i]) for i in range(len(parts))]
    shifted = [p.withColumn(sample, F.col(sample) + s).withColumn("epoch", F.lit(i)) for i, (p, s) in enumerate(zip(parts, starts, strict=True))]
    return reduce(lambda a, b: a.unionByName(b), shifted)


def mergepoints(epochs: DataFrame, keys: list[str], order: str, n: str, rate: float, width=None) -> DataFrame:
    """O-UNI-02: epochs with start/stop in samples (exclusive and inclusive running sums of n) and seconds."""
    rows = running(epochs, keys, order, [], {"stop_sample": F.col(n)}, "sum", width)
    rows = rows.withColumn("start_sample", F.col("stop_sample") - F.col(n))
    return rows.withColumn("start_s", F.col("start_sample") / rate).withColumn("stop_s", F.col("stop_sample") / rate)


def synthesize_index(epochs: DataFrame, keys: list[str], n: str) -> DataFrame:
    """O-UNI-04: keys, i for i = 0 to n - 1 of each epoch."""
    return epochs.filter(F.col(n) > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)).alias("i"))


def multi_session(epochs: DataFrame, session: str, order: list[str], rate: str, channels: str) -> DataFrame:
    """O-UNI-05: epochs numbered in order within their session, with a name NNN_session_epoch; raises unless rate and channels are one each and there are two sessions or more."""
    bad = epochs.agg(F.countDistinct(rate), F.countDistinct(channels), F.countDistinct(session)).first()  # one row
    if bad[0] != 1 or bad[1] != 1 or bad[2] < 2:
        raise ValueError("sessions must agree in rate and channels, and be two or more")
    n = F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long")
    return epochs.withColumn("number", n).withColumn("name", F.format_string("%03d_%s", n, F.col(session).cast("string")))


def append_units(a: DataFrame, b: DataFrame, unit: str) -> DataFrame:
    """O-UNI-06: a, then b with its unit numbers after a's; only common columns stay."""
    common = [c for c in a.columns if c in b.columns]
    top = a.agg(F.coalesce(F.max(unit), F.lit(0)).alias("_top"))
    moved = b.select(*common).crossJoin(F.broadcast(top)).withColumn(unit, F.col(unit) + F.col("_top")).drop("_top")  # top has one row
    return a.select(*common).unionByName(moved)


def union_missing(parts: list[DataFrame]) -> DataFrame:
    """O-UNI-07: union by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def transform_selected(rows: DataFrame, selected: Column, value: str, change: Column) -> DataFrame:
    """O-UNI-08, O-FLT-03: value changed in selected rows, passed on in the others; no row moves."""
    return rows.withColumn(value, F.when(selected, change).otherwise(F.col(value)))


def sorter_partitions(channels: DataFrame, mode: str, excluded: DataFrame | None = None) -> DataFrame:
    """O-UNI-09/10: name, probe, shank, channels (ascending) of each group of connected channels that isn't empty.

    mode: all, probe or shank. Raises if nothing is left. The table of channels is bounded by the probe.
    """
    left = channels.filter("connected").dropDuplicates(["ch"])
    if excluded is not None:
        left = left.join(excluded.select("ch"), "ch", "left_anti")
    by = {"all": [], "probe": ["probe"], "shank": ["probe", "shank"]}[mode]
    out = left.groupBy(*by).agg(F.sort_array(F.collect_list("ch")).alias("channels")).filter(F.size("channels") > 0)
    for c in ("probe", "shank"):
        if c not in by:
            out = out.withColumn(c, F.lit(None).cast("int"))
    label = {"all": F.lit("all"), "probe": F.concat(F.lit("probe"), F.col("probe").cast("string")), "shank": F.concat(F.lit("probe"), F.col("probe").cast("string"), F.lit("_shank"), F.col("shank").cast("string"))}[mode]
    return out.select(label.alias("name"), "probe", "shank", "channels")


def group_ids(channels: DataFrame, mode: str) -> DataFrame:
    """O-UNI-12: channels with group_id: 0 for all, the probe, or a dense number of (probe, shank) by first channel."""
    if mode == "all":
        return channels.withColumn("group_id", F.lit(0).cast("long"))
    if mode == "probe":
        return channels.withColumn("group_id", F.col("probe").cast("long"))
    first = channels.groupBy("probe", "shank").agg(F.min("ch").alias("_first"))  # one row a shank
    dense = first.withColumn("group_id", (F.row_number().over(Window.orderBy("_first")) - 1).cast("long")).drop("_first")
    return channels.join(dense, ["probe", "shank"])


def bad_channel_union(rejected: DataFrame, channels: DataFrame) -> DataFrame:
    """O-UNI-13: distinct channels that are rejected or disconnected, within the channel map."""
    both = rejected.select("ch").union(channels.filter("NOT connected").select("ch")).distinct()
    return both.join(channels.select("ch"), "ch", "left_semi")


def recentre_pairs(channels: DataFrame, pairs: DataFrame) -> DataFrame:
    """O-UNI-15: channels of paired shanks (pairs: shank, into) moved to the common shank with x around the group's mean."""
    joined = channels.join(pairs, "shank", "left").withColumn("shank", F.coalesce("into", "shank")).drop("into")
    mean = joined.groupBy("shank").agg(F.avg("x").alias("_x"))
    return joined.join(mean, "shank").withColumn("x", F.col("x") - F.col("_x")).drop("_x")
