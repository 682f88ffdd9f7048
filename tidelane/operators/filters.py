"""Projections, predicates and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import range_join


def null_where(rows: DataFrame, bad: Column, columns: list[str]) -> DataFrame:
    """O-FLT-05/06: columns become null where bad holds; a null condition leaves them."""
    return rows.withColumns({c: F.when(~F.coalesce(bad, F.lit(False)), F.col(c)) for c in columns})


def zero_where(rows: DataFrame, bad: Column, value: str) -> DataFrame:
    """O-FLT-02: value becomes 0 where bad holds, in its own type."""
    return rows.withColumn(value, F.when(bad, F.lit(0).cast(rows.schema[value].dataType)).otherwise(F.col(value)))


def channel_list(values: list[int] | None, n: int) -> list[int]:
    """O-FLT-04: all of 0..n-1 by default; else in order without repeats; out of range raises."""
    if values is None:
        return list(range(n))
    if any(not 0 <= v < n for v in values):
        raise ValueError("a channel is out of range")
    return list(dict.fromkeys(values))


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """O-FLT-07: even-odd rule by a horizontal ray; an edge counts from its lower end on, below its upper one."""
    inside = F.lit(False)
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y0 != y1:
            crosses = ((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            inside = inside != crosses
    return inside


def near_polyline(x: Column, y: Column, polygon: list[tuple[float, float]], margin: float) -> Column:
    """O-FLT-08: within margin of an edge of the closed polygon."""
    near = F.lit(False)
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        dx, dy = x1 - x0, y1 - y0
        size = dx * dx + dy * dy
        share = F.lit(0.0) if size == 0 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / size))
        px, py = x - (x0 + share * dx), y - (y0 + share * dy)
        near = near | (px * px + py * py <= margin * margin)
    return near


def without_groups(rows: DataFrame, labels: DataFrame, on: str, label: str, groups: list[str]) -> DataFrame:
    """O-FLT-09: rows whose unit has none of the labels."""
    return rows.join(labels.filter(F.col(label).isin(groups)).select(on), on, "left_anti")


def metric_filter(units: DataFrame, equal: dict[str, object] | None = None, contains: dict[str, str] | None = None, member: dict[str, DataFrame] | None = None, on: str = "unit") -> DataFrame:
    """O-FLT-10: all of: columns equal to a value, columns that contain a text, units in a table."""
    for c, v in (equal or {}).items():
        units = units.filter(F.col(c) == F.lit(v))
    for c, v in (contains or {}).items():
        units = units.filter(F.col(c).contains(v))
    for _, table in (member or {}).items():
        units = units.join(table.select(on), on, "left_semi")
    return units


def valid_times(spikes: DataFrame, t: str, low=None, high=None) -> DataFrame:
    """O-FLT-11: low <= t < high; pushed down to the scan."""
    if low is not None:
        spikes = spikes.filter(F.col(t) >= low)
    return spikes if high is None else spikes.filter(F.col(t) < high)


def blank_batches(samples: DataFrame, batch: Column, value: str, threshold: float, keys: list[str]) -> DataFrame:
    """O-FLT-12: value becomes 0 in batches where any |value| reaches the threshold; the largest of a batch comes from a partial aggregate."""
    rows = samples.withColumn("_batch", batch)
    hot = rows.filter(F.abs(value) >= threshold).select(*keys, "_batch").distinct().withColumn("_hot", F.lit(True))
    return rows.join(hot, [*keys, "_batch"], "left").withColumn(value, F.when(F.col("_hot"), F.lit(0).cast(samples.schema[value].dataType)).otherwise(F.col(value))).drop("_batch", "_hot")


def restrict(spikes: DataFrame, spans: DataFrame, keys: list[str], t: str, width) -> DataFrame:
    """O-FLT-13: spikes inside any span (ends closed)."""
    return range_join(spikes, spans, keys, t, "start", "stop", width, "left_semi")


def exclude(spikes: DataFrame, spans: DataFrame, keys: list[str], t: str, width) -> DataFrame:
    """O-FLT-13: spikes outside all spans (ends closed)."""
    return range_join(spikes, spans, keys, t, "start", "stop", width, "left_anti")


def text_filter(units: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """O-FLT-15: units with a match in any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).cast("string").rlike(pattern), F.lit(False))
    return units.filter(found)
