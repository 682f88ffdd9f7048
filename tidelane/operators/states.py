"""Brain states: bimodality, thresholds between peaks, classification, index and interval forms, episodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import in_intervals, merge_intervals, subtract_intervals
from .ordered import checkpointed, range_join, running


def dip_statistic(x: np.ndarray) -> float:
    """O-ST-03: the largest gap between the empirical distribution and the nearest unimodal one.

    For every possible mode the best convex-then-concave fit is bounded by the greatest convex minorant left of it and the
    least concave majorant right of it; the dip is half the smallest, over modes, of the largest distance to those hulls.
    """
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return 0.5 / n if n else 0.0
    values, first = np.unique(x, return_index=True)
    top = np.append(first[1:], n) / n  # the distribution just at each value
    low = first / n  # and just below

    def gaps(v: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """For each prefix, the largest height of the upper steps over the convex hull of the lower ones."""
        hull: list[int] = []
        out = np.zeros(len(v))
        worst: list[float] = []
        for i in range(len(v)):
            while len(hull) > 1 and (lower[hull[-1]] - lower[hull[-2]]) * (v[i] - v[hull[-1]]) >= (lower[i] - lower[hull[-1]]) * (v[hull[-1]] - v[hull[-2]]):
                hull.pop()
                worst.pop()
            if hull:
                a = hull[-1]
                inside = np.arange(a, i + 1)
                line = lower[a] + (lower[i] - lower[a]) * (v[inside] - v[a]) / (v[i] - v[a])
                height = float(np.max(upper[inside] - line))
                worst.append(max(height, worst[-1] if worst else 0.0))
            hull.append(i)
            out[i] = worst[-1] if worst else float(upper[i] - lower[i])
        return out

    left = gaps(values, low, top)
    right = gaps(-values[::-1], 1 - top[::-1], 1 - low[::-1])[::-1]
    return float(max(np.min(np.maximum(left, right)) / 2, 0.5 / n))


def bimodality(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """O-ST-01/04: keys, n, dip: the dip statistic by key; a channel's scores (one a second) are one group."""
    schema = samples.select(*keys).schema.add("n", "long").add("dip", "double")

    def dip(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].dropna().to_numpy()
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"n": [len(x)], "dip": [dip_statistic(x)]})

    return samples.select(*keys, value).groupBy(*keys).applyInPandas(dip, schema)


def best_channel(scores: DataFrame, ch: str, score: str) -> DataFrame:
    """O-ST-04: the channel with the highest score, the lower one on ties."""
    return scores.orderBy(F.desc(score), ch).limit(1)


def valley_threshold(samples: DataFrame, keys: list[str], value: str, least_bins: int = 12, most_bins: int = 30) -> DataFrame:
    """O-ST-05/06: keys, bins, threshold: centre of the first lowest bin between the two peaks of the first histogram (from least_bins on) with exactly two interior or end peaks; the middle of the range if none has.

    All bin numbers are counted in one pass over the samples; the search works on their few hundred bins a key.
    """
    ends = samples.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("hi > lo")
    sizes = F.explode(F.sequence(F.lit(least_bins), F.lit(most_bins)))
    rows = samples.filter(F.col(value).isNotNull()).join(ends, keys).withColumn("bins", sizes)
    at = F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))), F.col("bins") - 1).cast("int")
    counts = rows.groupBy(*keys, "lo", "hi", "bins", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(*keys, "lo", "hi", "bins").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"))
    per = per.withColumn("_h", F.transform(F.sequence(F.lit(0), F.col("bins") - 1), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0).cast("long"))))
    value_at = lambda i: F.when((i >= 1) & (i <= F.col("bins")), F.element_at("_h", F.greatest(F.least(i, F.col("bins")), F.lit(1)))).otherwise(F.lit(-1).cast("long"))
    peaks = F.filter(F.sequence(F.lit(1), F.col("bins")), lambda i: (value_at(i) > value_at(i - 1)) & (value_at(i) > value_at(i + 1)))
    per = per.withColumn("_p", peaks).filter(F.size("_p") == 2)
    inside = F.transform(F.sequence(F.col("_p")[0], F.col("_p")[1]), lambda i: F.struct(F.element_at("_h", i).alias("n"), i.alias("i")))
    per = per.withColumn("_b", F.array_min(inside).i)
    found = per.groupBy(*keys).agg(F.min_by(F.struct("bins", (F.col("lo") + (F.col("_b") - 0.5) * (F.col("hi") - F.col("lo")) / F.col("bins")).alias("threshold")), "bins").alias("_f"))
    return ends.join(found, keys, "left").select(*keys, F.col("_f.bins").alias("bins"), F.coalesce("_f.threshold", (F.col("lo") + F.col("hi")) / 2).alias("threshold"))


def classify(scores: DataFrame, slow_wave: str, emg: str, theta: str, sw_limit: float, emg_limit: float, theta_limit: float) -> DataFrame:
    """O-ST-09: scores with state: NREM above the slow-wave limit; else REM with low EMG and high theta; else WAKE."""
    return scores.withColumn("state", F.when(F.col(slow_wave) > sw_limit, "NREM").when((F.col(emg) < emg_limit) & (F.col(theta) > theta_limit), "REM").otherwise("WAKE"))


def intervals_to_index(spans: DataFrame, keys: list[str], order: dict[str, int]) -> DataFrame:
    """O-ST-08: keys, s, code for every whole second that a state covers (bounds rounded half to even); where states overlap the later one in `order` counts."""
    code = F.create_map(*[c for k, v in order.items() for c in (F.lit(k), F.lit(v))])
    rows = spans.withColumn("code", F.element_at(code, F.col("state"))).withColumn("s", F.explode(F.sequence(F.rint("start").cast("long"), F.rint("stop").cast("long"))))
    return rows.groupBy(*keys, "s").agg(F.max("code").alias("code"))


def overwrite(samples: DataFrame, spans: DataFrame, keys: list[str], t: str, state: str, new: str, width) -> DataFrame:
    """O-ST-10: state becomes `new` inside any span (ends closed)."""
    return in_intervals(samples, spans, keys, t, width, "_in").withColumn(state, F.when(F.col("_in"), F.lit(new)).otherwise(F.col(state))).drop("_in")


def episodes(spans: DataFrame, keys: list[str], packet: float, micro: float, width=None) -> dict[str, DataFrame]:
    """O-ST-12: of state intervals (state, start, stop): packets (NREM of at least `packet`), microarousals (WAKE up to `micro`), NREM episodes (packets joined over at most `micro`, without REM), WAKE episodes (longer WAKE)."""
    spans = checkpointed(spans.select(*keys, "state", "start", "stop"))
    cut = lambda s: spans.filter(F.col("state") == s).select(*keys, "start", "stop")
    size = F.col("stop") - F.col("start")
    packets = cut("NREM").filter(size >= packet)
    joined = merge_intervals(packets, keys, micro, None, width).drop("n")
    return {
        "packets": packets,
        "microarousals": cut("WAKE").filter(size <= micro),
        "nrem_episodes": subtract_intervals(joined, cut("REM"), keys, width).filter(size >= packet),
        "wake_episodes": cut("WAKE").filter(size > micro),
    }


def theta_epochs(samples: DataFrame, state: str, theta: str, emg: str, theta_limit: float, emg_limit: float) -> DataFrame:
    """O-ST-13: code 7 where theta and EMG exceed their limits, 9 for WAKE without theta, else the state's own."""
    high = F.coalesce((F.col(theta) > theta_limit) & (F.col(emg) > emg_limit), F.lit(False))
    still = (F.col(state) == "WAKE") & F.coalesce(F.col(theta) <= theta_limit, F.lit(False))
    return samples.withColumn("code", F.when(high, F.lit(7)).when(still, F.lit(9)).otherwise(F.when(F.col(state) == "WAKE", 1).when(F.col(state) == "NREM", 3).otherwise(5)))


def theta_score(spectra: DataFrame, keys: list[str], freq: str, residual: str, low: float = 5.0, high: float = 10.0) -> DataFrame:
    """O-ST-02: keys, peak (largest residual in the band), share (band's part of the mean positive residual)."""
    band = F.col(freq).between(low, high)
    positive = F.greatest(F.col(residual), F.lit(0.0))
    total = F.sum(positive)
    return spectra.groupBy(*keys).agg(F.max(F.when(band, F.col(residual))).alias("peak"), F.when(total > 0, F.sum(F.when(band, positive)) / total).alias("share"))


def state_fractions(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, seconds, share of the key's scored time."""
    own = spans.groupBy(*keys, "state").agg(F.sum(F.col("stop") - F.col("start")).alias("seconds"))
    return own.join(own.groupBy(*keys).agg(F.sum("seconds").alias("_t")), keys).withColumn("share", F.col("seconds") / F.col("_t")).drop("_t")


def spikes_by_state(spikes: DataFrame, spans: DataFrame, keys: list[str], t: str, width) -> DataFrame:
    """O-WIN-05: keys, unit, state, n, rate (per unit of time) inside states; pivot by state for one row a unit."""
    hits = range_join(spikes, spans, keys, t, "start", "stop", width)
    n = hits.groupBy(*keys, "unit", "state").agg(F.count(F.lit(1)).alias("n"))
    time = spans.groupBy(*keys, "state").agg(F.sum(F.col("stop") - F.col("start")).alias("_t"))
    return n.join(time, [*keys, "state"]).withColumn("rate", F.col("n") / F.col("_t")).drop("_t")


def longest_run_so_far(spans: DataFrame, keys: list[str], width=None) -> DataFrame:
    """spans with the longest duration up to and with each."""
    return running(spans, keys, "start", ["stop"], {"longest": F.col("stop") - F.col("start")}, "max", width)
