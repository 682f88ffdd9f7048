"""Interval algebra over (start, stop) rows by key. Bounds are numbers; width cuts a key's axis so that tasks stay bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import asof, checkpointed, previous, range_join, rank_of, running


def in_intervals(points: DataFrame, spans: DataFrame, keys: list[str], t: str, width, flag: str = "inside") -> DataFrame:
    """O-INT-01: points with whether any span of the key holds them, both ends closed; spans may overlap."""
    spans = checkpointed(merge_intervals(spans, keys, 0, None, width).select(*keys, F.col("start").alias("_a"), F.col("stop").alias("_b")))
    hit = asof(points, spans.withColumn(t, F.col("_a")), keys, t, ["_a", "_b"], width)
    return hit.withColumn(flag, F.coalesce(F.col(t) <= F.col("_b"), F.lit(False))).drop("_a", "_b")


def numbered_membership(points: DataFrame, spans: DataFrame, keys: list[str], t: str, span_id: str, width) -> DataFrame:
    """O-INT-02: a row for each point and span that holds it, with the point's rank inside the span."""
    hits = range_join(points, spans, keys, t, "start", "stop", width)
    return rank_of(hits, [*keys, span_id], t, [], "rank", width)


def merge_intervals(spans: DataFrame, keys: list[str], max_gap, min_duration=None, width=None) -> DataFrame:
    """O-INT-03: start, stop of spans joined while start - latest stop so far <= max_gap; shorter results than min_duration go.

    Spans are ordered by (start, stop). n says how many spans each result joins.
    """
    rows = running(spans.select(*keys, "start", "stop"), keys, "start", ["stop"], {"_reach": F.col("stop")}, "max", width, inclusive=False)
    rows = rows.withColumn("_new", F.when(F.col("start") - F.col("_reach") <= F.lit(max_gap), 0).otherwise(1))
    rows = running(rows, keys, "start", ["stop"], {"_group": F.col("_new")}, "sum", width)
    out = rows.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n")).drop("_group")
    return out if min_duration is None else out.filter(F.col("stop") - F.col("start") >= F.lit(min_duration))


def consolidate(spans: DataFrame, keys: list[str], epsilon, strict: bool = False, width=None) -> DataFrame:
    """O-INT-06: spans with the bounds (target_start, target_stop) of the union they belong to, bounds widened by epsilon.

    strict keeps spans apart that only touch.
    """
    rows = running(spans, keys, "start", ["stop"], {"_reach": F.col("stop")}, "max", width, inclusive=False)
    meets = F.col("start") - epsilon < F.col("_reach") + epsilon if strict else F.col("start") - epsilon <= F.col("_reach") + epsilon
    rows = running(rows.withColumn("_new", F.when(meets, 0).otherwise(1)), keys, "start", ["stop"], {"target": F.col("_new")}, "sum", width).drop("_new", "_reach")
    targets = rows.groupBy(*keys, "target").agg(F.min("start").alias("target_start"), F.max("stop").alias("target_stop"))
    return rows.join(targets, [*keys, "target"])


def subtract_intervals(a: DataFrame, b: DataFrame, keys: list[str], width=None) -> DataFrame:
    """O-INT-04/05: what is left of the union of a outside the union of b, as (start, stop) with start < stop."""
    mark = lambda df, x, y: df.select(*keys, F.col("start").alias("t"), F.lit(x).alias("da"), F.lit(y).alias("db")).union(df.select(*keys, F.col("stop").alias("t"), F.lit(-x).alias("da"), F.lit(-y).alias("db")))
    edges = checkpointed(mark(a, 1, 0).union(mark(b, 0, 1)).groupBy(*keys, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db")))
    open_ = running(edges, keys, "t", [], {"na": F.col("da"), "nb": F.col("db")}, "sum", width)
    parts = checkpointed(previous(open_, keys, "t", [], {"next_t": "t"}, width, backward=True).filter("na > 0 AND nb = 0 AND next_t IS NOT NULL"))
    return merge_intervals(parts.select(*keys, F.col("t").alias("start"), F.col("next_t").alias("stop")), keys, 0, None, width).drop("n")


def runs(samples: DataFrame, keys: list[str], t: str, state: str, width=None) -> DataFrame:
    """O-INT-07, O-ST-07: state, start, stop, n of maximal runs of equal state along t (null is a state of its own)."""
    rows = previous(samples.withColumn("_one", F.lit(1)), keys, t, [], {"_p": state, "_any": "_one"}, width)
    rows = rows.withColumn("_new", F.when(F.col("_any").isNotNull() & F.col("_p").eqNullSafe(F.col(state)), 0).otherwise(1))
    rows = running(rows, keys, t, [], {"_run": F.col("_new")}, "sum", width)
    return rows.groupBy(*keys, "_run", state).agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count(F.lit(1)).alias("n")).drop("_run")


def adjacent(a: DataFrame, b: DataFrame, keys: list[str], within, width) -> DataFrame:
    """O-INT-08: a with next_to_b (a b starts within `within` of its stop) and after_b (one stops so near its start)."""
    starts = b.select(*keys, (F.col("start") - within).alias("_lo"), (F.col("start") + within).alias("_hi"))
    stops = b.select(*keys, (F.col("stop") - within).alias("_lo"), (F.col("stop") + within).alias("_hi"))
    near = in_intervals(a, starts.select(*keys, F.col("_lo").alias("start"), F.col("_hi").alias("stop")), keys, "stop", width, "next_to_b")
    return in_intervals(near, stops.select(*keys, F.col("_lo").alias("start"), F.col("_hi").alias("stop")), keys, "start", width, "after_b")


def pair_on_off(on: DataFrame, off: DataFrame, keys: list[str], t: str, width=None) -> DataFrame:
    """O-INT-09: each on with the first off strictly after it; an on without one is dropped, several may share an off."""
    ends = off.select(*keys, t, F.col(t).alias("stop"))
    return asof(on, ends, keys, t, ["stop"], width, "forward", strict=True).filter("stop IS NOT NULL").withColumnRenamed(t, "start")


def periods(pulses: DataFrame, keys: list[str], lag, width=None) -> DataFrame:
    """O-INT-10: pulses whose start is more than lag after the previous start begin a period; it ends with its last pulse."""
    rows = previous(pulses.select(*keys, "start", "stop"), keys, "start", ["stop"], {"_p": "start"}, width)
    rows = running(rows.withColumn("_new", F.when(F.col("start") - F.col("_p") <= lag, 0).otherwise(1)), keys, "start", ["stop"], {"_period": F.col("_new")}, "sum", width)
    return rows.groupBy(*keys, "_period").agg(F.min("start").alias("start"), F.max_by("stop", F.struct("start", "stop")).alias("stop"), F.count(F.lit(1)).alias("n_pulses")).drop("_period")


def windows_around(peaks: DataFrame, t: str, before, after) -> DataFrame:
    """O-INT-11: [max(peak - before, 0), peak + after] around each peak, and its duration."""
    start = F.greatest(F.col(t) - before, F.lit(0))
    return peaks.withColumn("start", start).withColumn("stop", F.col(t) + after).withColumn("duration", F.col("stop") - F.col("start"))


def intersect_intervals(a: DataFrame, b: DataFrame, keys: list[str], width) -> DataFrame:
    """O-INT-13: a row for each pair that overlaps in more than a point: the columns of both, and its common start, stop.

    Other columns of a and b must have different names. Pairs are found in the first bucket that both meet.
    """
    cover = lambda df: F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("stop") / width).cast("long")))
    x = a.withColumn("_bucket", cover(a)).withColumnRenamed("start", "a_start").withColumnRenamed("stop", "a_stop")
    y = b.withColumn("_bucket", cover(b)).withColumnRenamed("start", "b_start").withColumnRenamed("stop", "b_stop")
    start, stop = F.greatest("a_start", "b_start"), F.least("a_stop", "b_stop")
    both = x.join(y, [*keys, "_bucket"]).filter((start < stop) & (F.floor(start / width) == F.col("_bucket")))
    return both.withColumn("start", start).withColumn("stop", stop).drop("_bucket")


def split_by(parents: DataFrame, cuts: DataFrame, keys: list[str], min_duration, width=None) -> DataFrame:
    """O-INT-15: parents cut at the cuts, pieces shorter than min_duration dropped."""
    return subtract_intervals(parents, cuts, keys, width).filter(F.col("stop") - F.col("start") >= min_duration)
