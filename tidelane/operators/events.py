"""Event operators: digital words, analog pulses, triggers, artifact windows, oscillation bursts, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import pair_on_off, periods, runs
from .ordered import asof, checkpointed, previous, range_join, rank_of, running
from .sequences import edges, fill_gaps, greedy_thin


def bits(words: DataFrame, word: str, n: int = 16, keys: tuple[str, ...] = ()) -> DataFrame:
    """words with one row for each of the n low bits: bit (number), on (0 or 1)."""
    return words.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("on", F.getbit(F.col(word).cast("long"), F.col("bit")).cast("int"))


def digital_pulses(words: DataFrame, keys: list[str], t: str, word: str, n: int = 16, width=None) -> DataFrame:
    """O-EVT-01: keys, bit, n, start, stop, duration of the n-th pulse of each bit.

    Edges are taken at the sample before a change and paired by position. If a bit's first edge is a fall, falls count as
    starts. A last start without an end has null stop. Words of one time go from the least to the greatest.
    """
    # only words that change are spread over their bits, and only over those that change
    steps = previous(words.select(*keys, t, F.col(word).cast("long").alias("_w")), keys, t, ["_w"], {"_next": "_w"}, width, backward=True)
    steps = steps.withColumn("_flip", F.col("_w").bitwiseXOR(F.col("_next")).bitwiseAND(F.lit((1 << n) - 1))).filter("_flip != 0")
    steps = steps.withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit("_flip", i) == 1)))
    keys = [*keys, "bit"]
    found = steps.select(*keys, t, "_w", F.when(F.getbit("_next", F.col("bit")) == 1, 1).otherwise(-1).alias("edge"))
    first = found.groupBy(*keys).agg(F.min_by("edge", F.struct(t, "_w")).alias("_first"))
    marked = found.join(first, keys).withColumn("_on", F.col("edge") == F.col("_first")).drop("_first")
    on = rank_of(marked.filter("_on").select(*keys, F.col(t).alias("start")), keys, "start", [], "n", width)
    off = rank_of(marked.filter("NOT _on").select(*keys, F.col(t).alias("stop")), keys, "stop", [], "n", width)
    return on.join(off, [*keys, "n"], "left").withColumn("duration", F.col("stop") - F.col("start"))


def word_intervals(changes: DataFrame, keys: list[str], t: str, word: str, end: Column, width=None) -> DataFrame:
    """O-EVT-02: start, stop, word: each change's word up to the sample before the next, or `end`; of words of one time the greatest; densify only where needed."""
    rows = previous(changes, keys, t, [word], {"_next": t}, width, backward=True)
    return rows.select(*keys, F.col(t).alias("start"), (F.coalesce("_next", end) - 1).alias("stop"), word).filter("stop >= start")


def words_on_grid(grid: DataFrame, changes: DataFrame, keys: list[str], t: str, word: str, width=None) -> DataFrame:
    """O-EVT-02/03: grid with the word in force at each sample, 0 before the first change."""
    return asof(grid, changes.select(*keys, t, word), keys, t, [word], width).withColumn(word, F.coalesce(word, F.lit(0)))


def rescale_analog(samples: DataFrame, value: str, offset: float = 6800.0, gain: float = 5.0 / 52200.0, sample: str | None = None, rate: float = 1250.0) -> DataFrame:
    """O-EVT-04: value as (x - offset) * gain; with `sample` also t in seconds at the fixed rate of 1250 Hz."""
    out = samples.withColumn(value, (F.col(value) - offset) * gain)
    return out if sample is None else out.withColumn("t", F.col(sample) / rate)


def analog_pulses(samples: DataFrame, keys: list[str], t: str, value: str, min_effectiveness: float = 0.3, factor: float = 4.5, keep_share: float = 0.4, min_duration=0, width=None) -> DataFrame:
    """O-EVT-05: keys, start, stop, amplitude (median inside), duration of pulses above factor * standard deviation.

    The key's median is taken off as an integer, the signal shifted to 0 and up. Keys whose two-class effectiveness is
    below the gate have no pulses. A pulse stays if its median is at least keep_share * (threshold - baseline).
    """
    from .stats import effectiveness

    base = samples.groupBy(*keys).agg(F.median(value).cast("int").alias("_base"))
    flat = samples.join(base, keys).withColumn("_v", F.col(value) - F.col("_base"))
    low = flat.groupBy(*keys).agg(F.min("_v").alias("_low"))
    lifted = flat.join(low, keys).withColumn("_v", F.col("_v") - F.least("_low", F.lit(0)))
    gate = effectiveness(lifted, keys, "_v").filter(F.col("effectiveness") >= min_effectiveness).select(*keys)
    cut = lifted.groupBy(*keys).agg((factor * F.stddev_pop("_v")).alias("_cut"), F.median("_v").alias("_mid"))
    rows = lifted.join(gate, keys, "left_semi").join(cut, keys).withColumn("_on", (F.col("_v") > F.col("_cut")).cast("int"))
    found = edges(rows, keys, t, "_on", width)
    pulses = pair_on_off(found.filter("edge = 1").select(*keys, t), found.filter("edge = -1").select(*keys, t), keys, t, width)
    inside = range_join(rows.select(*keys, t, "_v", "_cut", "_mid"), pulses, keys, t, "start", "stop", width or 1 << 40)
    out = inside.groupBy(*keys, "start", "stop").agg(F.median("_v").alias("amplitude"), F.first("_cut").alias("_cut"), F.first("_mid").alias("_mid"))
    out = out.filter(F.col("amplitude") >= keep_share * (F.col("_cut") - F.col("_mid"))).withColumn("duration", F.col("stop") - F.col("start"))
    return out.filter(F.col("duration") >= min_duration).select(*keys, "start", "stop", "amplitude", "duration")


def with_periods(pulses: DataFrame, keys: list[str], lag, width=None) -> DataFrame:
    """Pulses with the bounds of their period (O-INT-10)."""
    return range_join(pulses, periods(pulses, keys, lag, width).select(*keys, F.col("start").alias("period_start"), F.col("stop").alias("period_stop")), keys, "start", "period_start", "period_stop", width or 1 << 40)


def triggers(on: DataFrame, off: DataFrame | None, t: str, rate: float) -> DataFrame:
    """O-EVT-07: distinct sample numbers of finite on (and off) times, rounded half to even."""
    both = on.select(t) if off is None else on.select(t).union(off.select(t))
    return both.filter(F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))).select(F.rint(F.col(t) * rate).cast("long").alias("sample")).distinct()


def amplitude_threshold(samples: DataFrame, t: str, value: str, factor: float) -> DataFrame:
    """One row: factor * 1.4826 * median over samples of the median over channels of |value| (no deviation about a centre)."""
    return samples.groupBy(t).agg(F.median(F.abs(value)).alias("_m")).agg((factor * 1.4826 * F.median("_m")).alias("threshold"))


def high_amplitude_runs(samples: DataFrame, keys: list[str], t: str, value: str, threshold: DataFrame, width=None) -> DataFrame:
    """O-EVT-08: start, stop of runs of samples whose median over channels of |value| exceeds the threshold (one row, broadcast)."""
    level = samples.groupBy(*keys, t).agg(F.median(F.abs(value)).alias("_m")).crossJoin(F.broadcast(threshold))
    flags = level.withColumn("_on", F.col("_m") > F.col("threshold")).select(*keys, t, "_on")
    return runs(flags, keys, t, "_on", width).filter("_on").select(*keys, "start", "stop")


def artifact_triggers(spans: DataFrame, keys: list[str], dead, width=None) -> DataFrame:
    """O-EVT-08, last step: run starts thinned greedily by a dead time."""
    return greedy_thin(spans.select(*keys, F.col("start").alias("t")), keys, "t", dead, width)


def blank_artifacts(samples: DataFrame, triggers: DataFrame, keys: list[str], t: str, value: str, before, after, width=None) -> DataFrame:
    """O-EVT-09, linear mode: samples within [trigger - before, trigger + after] replaced by the line between their neighbours outside; kept where one is missing."""
    spans = triggers.select(*keys, (F.col(t) - before).alias("start"), (F.col(t) + after).alias("stop"))
    hit = range_join(samples.select(*keys, t), spans, keys, t, "start", "stop", width or 1 << 40).select(*keys, t).distinct().withColumn("_hit", F.lit(True))
    rows = samples.join(hit, [*keys, t], "left")
    holes = rows.withColumn("_v", F.when(F.col("_hit").isNull(), F.col(value).cast("double")))
    return fill_gaps(holes, keys, t, "_v", 1 << 60, width).withColumn(value, F.coalesce("_v", F.col(value).cast("double"))).drop("_v", "_hit")


def bursts(samples: DataFrame, keys: list[str], t: str, power: str, low: float, high: float, max_gap, shortest, longest, width=None) -> DataFrame:
    """O-EVT-11 after filtering: start, stop, peak_t, peak of events: runs with z-scored power above low, merged over gaps below max_gap, whose peak exceeds high, of a duration within bounds."""
    from .intervals import merge_intervals

    z = samples.groupBy(*keys).agg(F.avg(power).alias("_m"), F.stddev_samp(power).alias("_s"))
    scored = samples.join(z, keys).withColumn("z", (F.col(power) - F.col("_m")) / F.col("_s")).drop("_m", "_s")
    above = checkpointed(runs(scored.withColumn("_on", F.coalesce(F.col("z") > low, F.lit(False))), keys, t, "_on", width).filter("_on").select(*keys, "start", "stop"))
    joined = merge_intervals(above, keys, max_gap, None, width).drop("n")
    inside = range_join(scored.select(*keys, t, "z"), joined, keys, t, "start", "stop", width or 1 << 40)
    out = inside.groupBy(*keys, "start", "stop").agg(F.max("z").alias("peak"), F.min_by(F.col(t), F.struct(-F.col("z"), F.col(t))).alias("peak_t"))
    return out.filter((F.col("peak") > high) & (F.col("stop") - F.col("start")).between(shortest, longest))


def neighbour_event(events: DataFrame, t: str, at, direction: str) -> DataFrame:
    """O-EVT-13: the next or previous event around a time; a top-1 plan."""
    if direction == "next":
        return events.filter(F.col(t) > at).orderBy(t).limit(1)
    return events.filter(F.col(t) < at).orderBy(F.desc(t)).limit(1)


def event_aligned(samples: DataFrame, events: DataFrame, keys: list[str], t: str, value: str, before, after, width) -> DataFrame:
    """O-EVT-14: keys, lag, mean, deviation of samples around events."""
    spans = events.select(*keys, F.col(t).alias("_at"), (F.col(t) - before).alias("start"), (F.col(t) + after).alias("stop"))
    hits = range_join(samples, spans, keys, t, "start", "stop", width)
    return hits.groupBy(*keys, (F.col(t) - F.col("_at")).alias("lag")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count(F.lit(1)).alias("n"))


def bad_channels(aligned: DataFrame, ch: str, deviation: float = 70.0, reach: float = 10.0) -> DataFrame:
    """O-EVT-14: channels whose mean deviation exceeds a bound, or whose mean curve spans more than another."""
    out = aligned.groupBy(ch).agg(F.avg("deviation").alias("mean_deviation"), (F.max("mean") - F.min("mean")).alias("span"))
    return out.withColumn("bad", F.coalesce(F.col("mean_deviation") > deviation, F.lit(False)) | F.coalesce(F.col("span") > reach, F.lit(False)))


def zero_filled_epochs(epochs: DataFrame, sidecar: DataFrame, keys: list[str], n: str, word: str) -> DataFrame:
    """O-EVT-03, O-UNI-03: keys, i, word for every sample of every epoch; an epoch without sidecar rows gets zeros. Raises if an epoch has another count than its n."""
    counts = sidecar.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    checked = epochs.join(counts, keys, "left").withColumn("_ok", F.when(F.col("_have").isNull() | (F.col("_have") == F.col(n)), True).otherwise(F.raise_error(F.lit("an epoch's sidecar has another length"))))
    grid = checked.filter("_ok").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))).filter(F.col(n) > 0).select(*keys, "i")
    return grid.join(sidecar.select(*keys, "i", word), [*keys, "i"], "left").withColumn(word, F.coalesce(word, F.lit(0)))


def running_state(changes: DataFrame, keys: list[str], t: str, delta: str, width=None) -> DataFrame:
    """The sum of changes up to and with each row."""
    return running(changes, keys, t, [], {"state": F.col(delta)}, "sum", width)
