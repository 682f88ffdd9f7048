"""Robust statistics, histograms and inequality measures, by key. Medians and percentiles are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import previous, rank_of, running


def low_rate_units(spikes: DataFrame, labels: DataFrame, unit: str, t: str, seconds: Column, threshold: float, label: str = "label") -> DataFrame:
    """O-AGG-01: unit, n, rate, label over all units of either table; `noise` where n / seconds of the recording <= threshold."""
    total = spikes.agg(F.max(t).alias("_last"), F.min(t).alias("_first"))
    counts = spikes.groupBy(unit).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))  # one row
    rates = counts.withColumn("rate", F.col("n") / seconds).drop("_last", "_first")
    both = rates.join(labels.select(unit, label), unit, "full")
    return both.withColumn(label, F.when(F.coalesce(F.col("rate") <= threshold, F.lit(False)), "noise").otherwise(F.coalesce(F.col(label), F.lit("unsorted"))))


def robust_z(df: DataFrame, keys: list[str], value: str, out: str = "z") -> DataFrame:
    """O-AGG-04/05: 0.6745 * (x - median) / MAD by key; 0 where the MAD is 0, null where x is null."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("_med"))
    spread = df.join(middle, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"), F.first("_med").alias("_med"))
    z = F.when(F.col(value).isNull(), None).when(F.col("_mad") > 0, 0.6745 * (F.col(value) - F.col("_med")) / F.col("_mad")).otherwise(0.0)
    return df.join(spread, keys).withColumn(out, z).drop("_med", "_mad")


def min_max(df: DataFrame, keys: list[str], value: str, out: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """O-AGG-06: value scaled to low..high by key; a constant becomes low."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = low + (F.col(value) - F.col("_lo")) * (high - low) / (F.col("_hi") - F.col("_lo"))
    return df.join(ends, keys).withColumn(out, F.when(F.col("_hi") > F.col("_lo"), scaled).when(F.col(value).isNotNull(), low)).drop("_lo", "_hi")


def effectiveness(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """O-AGG-08: 1 - within-class / total variance (population), classes split at the middle of the range; 0 for constants."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.var_pop(value).alias("_var"), F.count(value).alias("_n"))
    rows = df.join(ends, keys).withColumn("_up", F.col(value) > (F.col("_lo") + F.col("_hi")) / 2)
    parts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, "_up").agg((F.var_pop(value) * F.count(value)).alias("_w"), F.first("_var").alias("_var"), F.first("_n").alias("_n"))
    out = parts.groupBy(*keys).agg(F.sum("_w").alias("_w"), F.first("_var").alias("_var"), F.first("_n").alias("_n"))
    return out.select(*keys, F.when(F.col("_var") > 0, 1 - F.col("_w") / F.col("_n") / F.col("_var")).otherwise(0.0).alias("effectiveness"))


def mad_mask(df: DataFrame, keys: list[str], value: str, scale: float, floor: float = 1e-6) -> DataFrame:
    """O-AGG-09: df with `kept`: |x - median| <= scale * max(MAD, floor)."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("_med"))
    spread = df.join(middle, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"), F.first("_med").alias("_med"))
    return df.join(spread, keys).withColumn("kept", F.coalesce(F.abs(F.col(value) - F.col("_med")) <= scale * F.greatest("_mad", F.lit(floor)), F.lit(False))).drop("_med", "_mad")


def gini(df: DataFrame, keys: list[str], value: str, width=None) -> DataFrame:
    """O-AGG-10: 1 - 2 * sum(cumulative share) / (n + 1) over ascending values, by key; 0 where all values are 0.

    Corrected to the textbook value ((n + 1) / n scaled): equal values give 0, one of n holding all gives 1 - 1/n after scaling by n/(n+1).
    """
    rows = rank_of(df.filter(F.col(value).isNotNull()), keys, value, [], "_i", width)
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col("_i")).alias("_si"), F.count(F.lit(1)).alias("_n"))
    # the sum of cumulative sums is sum((n + 1 - i) * x_i)
    return sums.select(*keys, F.when(F.col("_s") != 0, 1 - 2 * ((F.col("_n") + 1) * F.col("_s") - F.col("_si")) / F.col("_s") / (F.col("_n") + 1)).otherwise(0.0).alias("gini"))


def binned_counts(df: DataFrame, keys: list[str], t: str, bin_width, first: int, last: int) -> DataFrame:
    """O-AGG-11, dense bins: keys, bin (first to last), n; bins without rows have n = 0."""
    counts = df.groupBy(*keys, F.floor(F.col(t) / bin_width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("bin").between(first, last))
    grid = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    return grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rate_stability(bins: DataFrame, keys: list[str], width=None) -> DataFrame:
    """O-AGG-11: by key, cv (sample standard deviation / mean) and instability (median absolute step / mean) of dense bins' n."""
    rows = previous(bins, keys, "bin", [], {"_p": "n"}, width)
    mean = F.avg("n")
    return rows.groupBy(*keys).agg((F.stddev_samp("n") / mean).alias("cv"), (F.median(F.abs(F.col("n") - F.col("_p"))) / mean).alias("instability"))


def firing_rate(spikes: DataFrame, keys: list[str], t: str, ticks_per_second: float) -> DataFrame:
    """O-AGG-12: n, rate = n / (last - first) in seconds; null for a single instant."""
    span = (F.max(t) - F.min(t)) / ticks_per_second
    return spikes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(span > 0, F.count(F.lit(1)) / span).alias("rate"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """O-AGG-14: keys, bin (0 to bins - 1), centre, n: equal widths from least to greatest, the last bin closed; a constant has bins of width 1 / bins from it on. Empty bins have 0."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).filter("_lo IS NOT NULL")
    size = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(F.lit(1.0 / bins))
    ends = ends.withColumn("_w", size)
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("long")
    counts = df.filter(F.col(value).isNotNull()).join(ends, keys).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", (F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w")).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


def percentile_duration(spans: DataFrame, keys: list[str], share: float, low: float, high: float, ticks_per_second: float) -> DataFrame:
    """O-AGG-16: the durations' percentile (linear interpolation) in seconds, rounded to ms and clamped to low..high."""
    p = F.expr(f"percentile((stop - start) / {float(ticks_per_second)}, {share})")
    return spans.groupBy(*keys).agg(p.alias("_p")).select(*keys, F.least(F.greatest(F.round("_p", 3), F.lit(low)), F.lit(high)).alias("duration"))


def contamination(spikes: DataFrame, keys: list[str], t: str, refractory, ticks_per_second: float, width=None) -> DataFrame:
    """O-AGG-17: n, violations (intervals below refractory), contamination: violation rate over mean rate, clamped to 0..1."""
    rows = previous(spikes, keys, t, [], {"_p": t}, width)
    close = F.sum(F.when(F.col(t) - F.col("_p") < refractory, 1).otherwise(0))
    span, n = (F.max(t) - F.min(t)) / ticks_per_second, F.count(F.lit(1))
    out = rows.groupBy(*keys).agg(n.alias("n"), close.alias("violations"), span.alias("_span"))
    rp = refractory / ticks_per_second
    rate = F.col("violations") * F.col("_span") / (2 * rp * F.col("n") * F.col("n"))
    return out.select(*keys, "n", "violations", F.when(F.col("_span") > 0, F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0))).alias("contamination"))


def covariance(df: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """O-AGG-18: keys, i, j, mean product of components i and j, from partial sums on every task: size**2 rows a key, whatever the number of vectors."""
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.col(vector)[i].cast("double") * F.col(vector)[j].cast("double")).alias("p")))))
    return df.select(*keys, F.explode(cells).alias("c")).groupBy(*keys, "c.i", "c.j").agg(F.avg("c.p").alias("moment"))


def ks_statistic(a: DataFrame, b: DataFrame, keys: list[str], value: str, width=None) -> DataFrame:
    """O-AGG-15: the two-sample Kolmogorov-Smirnov statistic and its asymptotic p-value, by key of both samples."""
    n = lambda df, c: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c))
    steps = a.select(*keys, value, F.lit(1).alias("da"), F.lit(0).alias("db")).union(b.select(*keys, value, F.lit(0), F.lit(1)))
    steps = steps.groupBy(*keys, value).agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    rows = running(steps, keys, value, [], {"ca": F.col("da"), "cb": F.col("db")}, "sum", width).join(n(a, "na"), keys).join(n(b, "nb"), keys)
    d = rows.groupBy(*keys).agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("d"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    m = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    x = F.greatest((F.sqrt(m) + 0.12 + 0.11 / F.sqrt(m)) * F.col("d"), F.lit(1e-3))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(101)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return d.withColumn("p", F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0))).select(*keys, "d", "p")


def global_top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows by order: a top-k plan, no global sort."""
    return df.orderBy(*order).limit(n)


def lag_free_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """O-AGG-19: distinct values."""
    return df.select(*columns).distinct()


def position_in_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """O-WIN-18: the first k rows of each key; Spark keeps k rows a key and task before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)
