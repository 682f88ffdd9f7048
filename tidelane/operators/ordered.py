"""Ordered computations whose tasks stay bounded: running aggregates, neighbours and as-of lookups in two levels.

A window over a key sorts all rows of that key in one task, so one hot key is one long task. Here a key's axis is cut
into buckets of a given width. Rows are ordered within (key, bucket); buckets are summarised to one row each, and what has
to cross a bucket's border comes from those summaries. Without a width the whole key is one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ALL, _NOW = Window.unboundedPreceding, Window.currentRow


def bucket_of(order: str, width: int | float | None) -> Column:
    return F.lit(0).cast("long") if width is None else F.floor(F.col(order) / F.lit(width)).cast("long")


def _over(how: str, value: Column, window) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min}[how](value).over(window) if how in ("sum", "max", "min") else F.last(value, ignorenulls=True).over(window)


def running(df: DataFrame, keys: list[str], order: str, ties: list[str], values: dict[str, Column], how: str, width=None, inclusive: bool = True, backward: bool = False) -> DataFrame:
    """df with running aggregates `how` (sum, max, min, or last non-null) of values along order, by key.

    inclusive takes the row itself in; backward runs from the end ('last' is then the next non-null). Rows of equal
    order are told apart by ties, which must stay within a bucket's reach as order alone picks the bucket. Where no row
    contributes the result is null.
    """
    cells = {f"_v{i}": v for i, v in enumerate(values.values())}
    rows = df.withColumn("_bucket", bucket_of(order, width)).withColumns(cells)
    turn = (lambda c: F.desc_nulls_last(c)) if backward else (lambda c: F.asc_nulls_first(c))
    window = Window.partitionBy(*keys, "_bucket").orderBy(*map(turn, [order, *ties])).rowsBetween(_ALL, _NOW if inclusive else -1)
    rows = rows.withColumns({f"_in{i}": _over(how, F.col(f"_v{i}"), window) for i in range(len(cells))})
    if width is not None:
        if how == "last":
            best = F.min_by if backward else F.max_by
            whole = [best(F.when(F.col(f"_v{i}").isNotNull(), F.col(f"_v{i}")), F.when(F.col(f"_v{i}").isNotNull(), F.struct(order, *ties))).alias(f"_w{i}") for i in range(len(cells))]
        else:
            whole = [{"sum": F.sum, "max": F.max, "min": F.min}[how](f"_v{i}").alias(f"_w{i}") for i in range(len(cells))]
        across = Window.partitionBy(*keys).orderBy(turn("_bucket")).rowsBetween(_ALL, -1)
        before = rows.groupBy(*keys, "_bucket").agg(*whole).select(*keys, "_bucket", *[_over(how, F.col(f"_w{i}"), across).alias(f"_b{i}") for i in range(len(cells))])
        rows = rows.join(before, [*keys, "_bucket"])
    out = {}
    for i, name in enumerate(values):
        inside, outside = F.col(f"_in{i}"), F.col(f"_b{i}") if width is not None else F.lit(None)
        if how == "sum":
            out[name] = F.when(inside.isNull() & outside.isNull(), None).otherwise(F.coalesce(inside, F.lit(0)) + F.coalesce(outside, F.lit(0))) if width is not None else inside
        elif how == "max":
            out[name] = F.greatest(inside, outside) if width is not None else inside
        elif how == "min":
            out[name] = F.least(inside, outside) if width is not None else inside
        else:
            out[name] = F.coalesce(inside, outside) if width is not None else inside
    return rows.withColumns(out).drop("_bucket", *[f"_{x}{i}" for i in range(len(cells)) for x in ("v", "in", "w", "b")])


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the session's checkpoint folder (spark.checkpoint.dir); in local mode a temporary one if that is unset.

    Two-level operators read their input twice, so a chain of them doubles the plan at every step: cut it where chains meet."""
    import tempfile

    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="tidelane-"))
    return df.checkpoint()


def previous(df: DataFrame, keys: list[str], order: str, ties: list[str], values: dict[str, str], width=None, backward: bool = False) -> DataFrame:
    """df with the values of the row before (after, if backward): new name -> column. Null at the end of a key."""
    packed = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(values.values())])
    rows = running(df, keys, order, ties, {"_prev": packed}, "last", width, inclusive=False, backward=backward)
    return rows.withColumns({n: F.col(f"_prev.f{i}") for i, n in enumerate(values)}).drop("_prev")


def rank_of(df: DataFrame, keys: list[str], order: str, ties: list[str], out: str, width=None) -> DataFrame:
    """df with each row's number in its key, from 1."""
    return running(df, keys, order, ties, {out: F.lit(1).cast("long")}, "sum", width)


def asof(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str], width=None, direction: str = "backward", strict: bool = False) -> DataFrame:
    """left with right's values at the nearest right row at or before (backward), or at or after (forward) its order.

    strict excludes equal order. Of right rows with equal order the one with the greatest (backward) or least (forward)
    values is taken. left keeps all rows; without a match the values are null.
    """
    columns = left.columns
    back = direction == "backward"
    lead = (1 if back else 0) if not strict else (0 if back else 1)
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in columns], *keys, F.col(order).alias("_t"), F.lit(lead).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_pack"))  # noqa: E741
    r = right.select(*[F.lit(None).cast(left.schema[c].dataType).alias(f"l_{c}") for c in columns], *keys, F.col(order).alias("_t"), F.lit(1 - lead).alias("_side"), F.struct(*values).alias("_pack"))
    both = running(l.withColumn("_left", F.lit(True)).union(r.withColumn("_left", F.lit(False))), keys, "_t", ["_side", "_pack"], {"_hit": F.col("_pack")}, "last", width, backward=not back)
    return both.filter("_left").select(*[F.col(f"l_{c}").alias(c) for c in columns], *[F.col(f"_hit.{v}").alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str, width=None, tolerance=None) -> DataFrame:
    """left with right's value at the nearest order, a tie going to the later one; null beyond tolerance."""
    r = right.withColumn("_at", F.col(order))
    both = asof(asof(left, r.select(*keys, order, F.col("_at").alias("_t0"), F.col(value).alias("_v0")), keys, order, ["_t0", "_v0"], width), r.select(*keys, order, F.col("_at").alias("_t1"), F.col(value).alias("_v1")), keys, order, ["_t1", "_v1"], width, "forward")
    before, after = F.col(order) - F.col("_t0"), F.col("_t1") - F.col(order)
    later = F.col("_t0").isNull() | (after <= before)
    gap = F.when(later & F.col("_t1").isNotNull(), after).otherwise(before)
    found = F.when(later & F.col("_t1").isNotNull(), F.col("_v1")).otherwise(F.col("_v0"))
    return both.withColumn(value, found if tolerance is None else F.when(gap <= tolerance, found)).drop("_t0", "_v0", "_t1", "_v1")


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, stop: str, width, how: str = "inner", closed: str = "both") -> DataFrame:
    """points with the spans of their key that contain them (closed: both, left or right end).

    Each span is copied to the buckets of `width` that it meets, so the join is an equi-join on (key, bucket) and never
    a nested loop. Choose the width near the typical span: a span costs its length / width + 1 copies.
    """
    # stop before start: an empty span, which meets no bucket
    cover = F.explode(F.sequence(bucket_of(start, width), F.greatest(bucket_of(start, width), bucket_of(stop, width))))
    s = spans.filter(F.col(start) <= F.col(stop)).withColumn("_bucket", cover)
    p = points.withColumn("_bucket", bucket_of(point, width))
    low = F.col(point) >= F.col(start) if closed in ("both", "left") else F.col(point) > F.col(start)
    high = F.col(point) <= F.col(stop) if closed in ("both", "right") else F.col(point) < F.col(stop)
    if how in ("left_semi", "left_anti", "left"):
        on = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "_bucket"]]
        low = F.col(f"p.{point}") >= F.col(f"s.{start}") if closed in ("both", "left") else F.col(f"p.{point}") > F.col(f"s.{start}")
        high = F.col(f"p.{point}") <= F.col(f"s.{stop}") if closed in ("both", "right") else F.col(f"p.{point}") < F.col(f"s.{stop}")
        joined = p.alias("p").join(s.alias("s"), on + [low, high], how)
        keep = [F.col(f"p.{c}") for c in points.columns]
        return joined.select(*keep) if how != "left" else joined.select(*keep, *[F.col(f"s.{c}") for c in spans.columns if c not in points.columns])
    return p.join(s, [*keys, "_bucket"]).filter(low & high).drop("_bucket")
