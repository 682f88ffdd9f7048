"""Sampled signals in long form (ch, s, v): filters in chunks with a halo, references, spectra, correlations.

A chunk and its halo are the unit of Python work: a channel of any length is many small groups, and each sample belongs to
the core of one chunk only. Filters have finite response and zero phase, so a chunk's core does not depend on the chunk length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_halo(samples: DataFrame, s: str, chunk: int, halo: int) -> DataFrame:
    """samples with `chunk` and `core`: every sample in its own chunk (core) and copied to those whose halo reaches it."""
    own = F.floor(F.col(s) / chunk)
    near = F.filter(F.array(own - 1, own, own + 1), lambda c: (F.col(s) >= c * chunk - halo) & (F.col(s) < (c + 1) * chunk + halo))
    if halo > chunk:
        raise ValueError("the halo must not exceed the chunk")
    return samples.withColumn("chunk", F.explode(near)).withColumn("core", F.col("chunk") == own)


def by_chunk(samples: DataFrame, keys: list[str], s: str, value: str, change, chunk: int, halo: int) -> DataFrame:
    """value replaced by change(array) of the chunk with its halo; samples must be dense in s within a key."""
    rows = with_halo(samples.select(*keys, s, F.col(value).cast("double").alias(value)), s, chunk, halo)
    schema = samples.select(*keys, s, F.col(value).cast("double").alias(value)).schema

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(s)
        pdf[value] = change(pdf[value].to_numpy())
        return pdf[pdf["core"]][[*keys, s, value]]

    return rows.groupBy(*keys, "chunk").applyInPandas(apply, schema)


def sinc_kernel(low: float | None, high: float | None, rate: float, reach: int) -> np.ndarray:
    """A zero-phase band-pass of 2 * reach + 1 taps (Blackman window): low-pass without low, high-pass without high."""
    k = np.arange(-reach, reach + 1)
    window = np.blackman(2 * reach + 3)[1:-1]

    def low_pass(cut: float) -> np.ndarray:
        taps = 2 * cut / rate * np.sinc(2 * cut / rate * k) * window
        return taps / taps.sum()

    unit = (k == 0).astype(float)
    taps = low_pass(high) if high else unit
    return taps - low_pass(low) if low else taps


def filtered(samples: DataFrame, keys: list[str], s: str, value: str, low: float | None, high: float | None, rate: float, reach: int = 64, chunk: int = 4096) -> DataFrame:
    """O-SIG-01/16/17: band-pass, high-pass or low-pass; ends are extended by their last value."""
    taps = sinc_kernel(low, high, rate, reach)
    return by_chunk(samples, keys, s, value, lambda x: np.convolve(np.pad(x, reach, mode="edge"), taps, mode="valid"), chunk, reach)


def common_reference(samples: DataFrame, keys: list[str], s: str, value: str) -> DataFrame:
    """O-SIG-01: value minus the median over channels at each sample."""
    middle = samples.groupBy(*keys, s).agg(F.median(value).alias("_m"))
    return samples.join(middle, [*keys, s]).withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def local_reference(samples: DataFrame, contacts: DataFrame, s: str, value: str, inner: float, outer: float) -> DataFrame:
    """O-SIG-01: value minus the median over the channels at a distance from inner to outer; unchanged without any. contacts (ch, x, y) are a bounded table."""
    a, b = contacts.select("ch", "x", "y"), contacts.select(F.col("ch").alias("_ch"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    near = F.broadcast(a.join(b, F.col("ch") != F.col("_ch")).filter(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")).between(inner, outer)).select("ch", "_ch"))
    other = samples.select(F.col("ch").alias("_ch"), s, F.col(value).alias("_v")).join(near, "_ch").groupBy("ch", s).agg(F.median("_v").alias("_m"))
    return samples.join(other, ["ch", s], "left").withColumn(value, F.col(value) - F.coalesce("_m", F.lit(0.0))).drop("_m")


def decimate(samples: DataFrame, s: str, factor: int) -> DataFrame:
    """O-SIG-04: every factor-th sample, renumbered."""
    return samples.filter(F.col(s) % factor == 0).withColumn(s, (F.col(s) / factor).cast("long"))


def lfp(samples: DataFrame, keys: list[str], s: str, value: str, rate: float, to_rate: float, cut: float = 450.0) -> DataFrame:
    """O-SIG-05/06: low-pass below both Nyquist limits, then every (rate / to_rate)-th sample."""
    factor = round(rate / to_rate)
    cut = min(cut, 0.45 * rate, 0.45 * to_rate)
    return decimate(filtered(samples, keys, s, value, None, cut, rate), s, factor)


def resampled(samples: DataFrame, keys: list[str], s: str, value: str, rate: float, to_rate: float, cut: float | None = None, reach: int = 64, chunk: int = 4096) -> DataFrame:
    """O-SIG-06: samples at another rate, whole ratio or not: sample i is the low-passed signal (below cut and both Nyquist limits) at i / to_rate, by a windowed sinc; ends are extended by their last value."""
    cut = min(cut or rate, 0.45 * rate, 0.45 * to_rate)
    ratio = rate / to_rate
    rows = with_halo(samples.select(*keys, s, F.col(value).cast("double").alias(value)), s, chunk, reach)
    schema = samples.select(*keys, s, F.col(value).cast("double").alias(value)).schema

    def at(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(s)
        core = pdf[s][pdf["core"]]
        if not len(core):  # a halo beyond the ends
            return pdf[[*keys, s, value]].iloc[:0]
        first, last = int(core.iloc[0]), int(core.iloc[-1])
        i = np.arange(int(np.ceil(first / ratio - 1e-9)), int(np.ceil((last + 1) / ratio - 1e-9)))
        place = i * ratio
        near = np.floor(place + 1e-9).astype(np.int64)[:, None] + np.arange(-reach + 1, reach + 1)[None, :]
        gap = near - place[:, None]
        taps = np.sinc(2 * cut / rate * gap) * (0.42 + 0.5 * np.cos(np.pi * gap / (reach + 1)) + 0.08 * np.cos(2 * np.pi * gap / (reach + 1)))
        x = pdf[value].to_numpy()[np.clip(near - int(pdf[s].iloc[0]), 0, len(pdf) - 1)]
        out = (x * taps).sum(axis=1) / taps.sum(axis=1)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(i) for k in keys} | {s: i.astype(np.int64), value: out})

    return rows.groupBy(*keys, "chunk").applyInPandas(at, schema)


def log_spectrum(samples: DataFrame, keys: list[str], s: str, value: str, rate: float, low: float, high: float, points: int, averages: int = 100, least: int = 2, overlap: float = 0.5) -> DataFrame:
    """O-SUP-28: keys, freq, power at points spaced evenly in log frequency: each has a segment length of its own, between the resolution that the spacing asks for and
    that which leaves `averages` (or at least `least`) segments; power is the mean squared magnitude of Hann-tapered segments without their mean. A key's samples are one group: an excerpt.
    """
    schema = samples.select(*keys).schema.add("freq", "double").add("power", "double")

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(s)[value].to_numpy(dtype=float)
        n, step = len(x), np.log(high / low) / (points - 1)
        freq = low * np.exp(step * np.arange(points))
        wanted = freq * (np.exp(step) - 1)
        average, floor = (rate / n * (1 + (1 - overlap) * (k - 1)) for k in (averages, least))
        resolution = np.where(wanted >= average, wanted, np.maximum(np.sqrt(average * wanted), floor))
        power = []
        for f, r in zip(freq, resolution, strict=True):
            size = min(max(int(round(rate / r)), 2), n)
            hop = max(1, int(round(size * (1 - overlap))))
            cuts = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
            wave = np.hanning(size) * np.exp(-2j * np.pi * f / (rate / size) * np.arange(size) / size)
            power.append(float(np.mean(np.abs((cuts - cuts.mean(axis=1, keepdims=True)) @ wave) ** 2)))
        return pd.DataFrame({k: [pdf[k].iloc[0]] * points for k in keys} | {"freq": freq, "power": power})

    return samples.select(*keys, s, value).groupBy(*keys).applyInPandas(spectrum, schema)


def good_channels(samples: DataFrame, s: str, value: str, threshold: float, rate: float, least_hz: float) -> DataFrame:
    """O-SIG-20: ch, rate: channels whose signal falls below -threshold at least so often a second (a crossing is a sample below after one that isn't)."""
    from .ordered import previous

    down = (F.col(value) < -threshold).cast("int")
    rows = previous(samples.withColumn("_d", down), ["ch"], s, [], {"_p": "_d"}, 1 << 16)
    total = rows.groupBy("ch").agg((F.sum(F.when((F.col("_d") == 1) & (F.coalesce("_p", F.lit(0)) == 0), 1).otherwise(0)) / ((F.max(s) - F.min(s) + 1) / rate)).alias("rate"))
    return total.filter(F.col("rate") >= least_hz)


def overlapping(samples: DataFrame, s: str, window: int, hop: int) -> DataFrame:
    """O-SUP-23: samples with `window` (its number) and `place`: each in all windows of that many samples, one every `hop`, that hold it."""
    first = F.greatest(F.ceil((F.col(s) - window + 1) / hop), F.lit(0))
    return samples.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor(F.col(s) / hop).cast("long")))).withColumn("place", F.col(s) - F.col("window") * hop)


def spectrogram(samples: DataFrame, keys: list[str], s: str, value: str, window: int, rate: float, freqs: list[float]) -> DataFrame:
    """O-SIG-07: keys, window, freq, magnitude of Hamming-windowed transforms, interpolated to freqs; windows of `window` samples side by side, incomplete ones left out."""
    size = 1 << int(np.ceil(np.log2(max(256, 2 * window))))
    taper = np.hamming(window)
    grid = np.fft.rfftfreq(size, 1 / rate)
    rows = samples.select(*keys, F.floor(F.col(s) / window).alias("window"), s, F.col(value).cast("double").alias("v"))
    schema = rows.select(*keys, "window").schema.add("freq", "double").add("magnitude", "double")

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < window:
            return pd.DataFrame({f.name: [] for f in schema})
        x = pdf.sort_values(s)["v"].to_numpy()
        found = np.interp(freqs, grid, np.abs(np.fft.rfft(x * taper, size)))
        head = {k: [pdf[k].iloc[0]] * len(freqs) for k in [*keys, "window"]}
        return pd.DataFrame(head | {"freq": freqs, "magnitude": found})

    return rows.groupBy(*keys, "window").applyInPandas(transform, schema)


def spectrum_slope(spectra: DataFrame, keys: list[str], freq: str, power: str, reach: int = 2) -> tuple[DataFrame, DataFrame]:
    """O-SIG-08: (slope and intercept of log power over log frequency by key, spectra with the residual over the median of neighbouring frequencies)."""
    logs = spectra.filter((F.col(freq) > 0) & (F.col(power) > 0)).withColumn("_f", F.log10(freq)).withColumn("_p", F.log10(power))
    line = logs.groupBy(*keys).agg(F.regr_slope("_p", "_f").alias("slope"), F.regr_intercept("_p", "_f").alias("intercept"))
    w = Window.partitionBy(*keys).orderBy(freq)  # a spectrum's frequencies: bounded
    around = F.array_sort(F.concat(F.collect_list("_p").over(w.rowsBetween(-reach, -1)), F.collect_list("_p").over(w.rowsBetween(1, reach))))
    n = F.size("_a")
    middle = (F.element_at("_a", (F.floor((n + 1) / 2)).cast("int")) + F.element_at("_a", (F.floor(n / 2) + 1).cast("int"))) / 2
    flat = logs.withColumn("_a", around).withColumn("residual", F.when(n > 0, F.col("_p") - middle))
    return line, flat.drop("_a", "_f", "_p")


def gram(samples: DataFrame, s: str, value: str, keys: list[Column], block: int = 1024, channels: list | None = None) -> DataFrame:
    """keys, ch, other, n, xy, x, y, xx, yy: sums over the samples that both channels have, of every pair of channels (ch < other, and each with itself).

    Samples meet in blocks of `block` sample numbers; a block is one matrix product and gives one row a pair, so no sample is ever
    multiplied by its pairs in an exchange. keys are expressions of the sample number that are constant within a block.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = samples if channels is None else samples.filter(F.col("ch").isin(channels))
    rows = rows.select(*named, F.floor(F.col(s) / block).alias("_b"), "ch", F.col(s).alias("_s"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    heads = [f"_k{i}" for i in range(len(keys))]
    schema = rows.select(*heads, "ch", F.col("ch").alias("other")).schema
    for name in ("n", "xy", "x", "y", "xx", "yy"):
        schema = schema.add(name, "double")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="_s", columns="ch", values="_v")
        names = list(wide.columns)
        there = wide.notna().to_numpy(dtype=float)
        v = wide.fillna(0.0).to_numpy()
        n, xy, x, xx = there.T @ there, v.T @ v, v.T @ there, (v * v).T @ there
        i, j = np.triu_indices(len(names))
        head = {k: [pdf[k].iloc[0]] * len(i) for k in heads}
        return pd.DataFrame(head | {"ch": [names[k] for k in i], "other": [names[k] for k in j], "n": n[i, j], "xy": xy[i, j], "x": x[i, j], "y": x[j, i], "xx": xx[i, j], "yy": xx[j, i]})

    sums = rows.groupBy(*heads, "_b").applyInPandas(products, schema)
    return sums.groupBy(*heads, "ch", "other").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "x", "y", "xx", "yy")])


def _correlation() -> Column:
    """Pearson's r from gram()'s sums, null for a constant."""
    n = F.col("n")
    across = n * F.col("xy") - F.col("x") * F.col("y")
    spread = lambda a, aa: F.greatest(n * F.col(aa) - F.col(a) * F.col(a), F.lit(0.0))
    tiny = lambda a, aa: spread(a, aa) <= 1e-12 * n * F.col(aa)
    return F.when(tiny("x", "xx") | tiny("y", "yy"), None).otherwise(across / F.sqrt(spread("x", "xx") * spread("y", "yy")))


def pairwise_correlation(samples: DataFrame, s: str, value: str, window: int, channels: list) -> DataFrame:
    """O-SIG-10: window, correlation: mean over channel pairs of Pearson's r in each window; a flat pair counts as 0.

    A window is one block of gram(), or several if it is long.
    """
    block = next(window // k for k in range(-(-window // 4096), window + 1) if window % k == 0)
    sums = gram(samples, s, value, [F.floor(F.col(s) / window)], block, channels).filter("ch != other")
    return sums.groupBy(F.col("_k0").alias("window")).agg(F.avg(F.coalesce(_correlation(), F.lit(0.0))).alias("correlation"))


def emg(samples: DataFrame, s: str, value: str, rate: float, window: int, channels: list) -> DataFrame:
    """O-SIG-11/13: mean pairwise correlation of the band from 300 Hz to 25 Hz below Nyquist (scaled down if the rate is low)."""
    high = rate / 2 - 25 if rate / 2 - 25 > 300 else rate / 2 * 0.9
    low = 300.0 if rate / 2 - 25 > 300 else rate / 2 * 0.3
    return pairwise_correlation(filtered(samples, ["ch"], s, value, low, high, rate), s, value, window, channels)


def emg_channels(contacts: DataFrame, groups: str, bad: DataFrame | None = None, least: int = 2, one_group: int = 5) -> DataFrame:
    """O-SIG-12: the first good channel of each group; with fewer than `least`, the first good ones of all. contacts are a bounded table."""
    good = contacts if bad is None else contacts.join(bad.select("ch"), "ch", "left_anti")
    first = good.groupBy(groups).agg(F.min("ch").alias("ch")).select("ch")
    if first.limit(least).count() >= least:
        return first
    return good.select("ch").orderBy("ch").limit(one_group)


def analytic_phase(samples: DataFrame, keys: list[str], s: str, value: str, chunk: int = 4096, halo: int = 1024) -> DataFrame:
    """O-SIG-14: phase (-pi to pi) of the analytic signal, chunkwise with a halo."""

    def phase(x: np.ndarray) -> np.ndarray:
        n = len(x)
        f = np.fft.fft(x)
        gain = np.zeros(n)
        gain[0] = 1
        gain[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            gain[n // 2] = 1
        return np.angle(np.fft.ifft(f * gain))

    return by_chunk(samples, keys, s, value, phase, chunk, halo)


def peak_frequency(phases: DataFrame, events: DataFrame, s: str, phase: str, rate: float) -> DataFrame:
    """O-SIG-15: events (ch, peak) with the instantaneous frequency at their peak, from the wrapped step of the phase around it."""
    before = phases.select("ch", (F.col(s) + 1).alias("peak"), F.col(phase).alias("_a"))
    after = phases.select("ch", (F.col(s) - 1).alias("peak"), F.col(phase).alias("_b"))
    step = F.pmod(F.col("_b") - F.col("_a") + np.pi, F.lit(2 * np.pi)) - np.pi
    return events.join(before, ["ch", "peak"]).join(after, ["ch", "peak"]).withColumn("frequency", F.abs(step) / 2 * rate / (2 * np.pi)).drop("_a", "_b")


def channel_covariance(samples: DataFrame, s: str, value: str) -> DataFrame:
    """O-AGG-18, O-SIG-18: ch, other, moment (mean product) of all channel pairs, both ways, from gram()'s sums."""
    half = gram(samples, s, value, []).select("ch", "other", (F.col("xy") / F.col("n")).alias("moment")).filter("moment IS NOT NULL")
    return half.union(half.filter("ch != other").select(F.col("other"), F.col("ch"), "moment"))


def whitening_matrix(moments: DataFrame, eps: float = 1e-6) -> tuple[list, np.ndarray]:
    """O-SIG-18: channels and the ZCA matrix U (S + eps)**-1/2 U' of their covariance (channels squared numbers on the driver)."""
    rows = moments.collect()
    names = sorted({r["ch"] for r in rows})
    at = {c: i for i, c in enumerate(names)}
    cov = np.zeros((len(names), len(names)))
    for r in rows:
        cov[at[r["ch"]], at[r["other"]]] = r["moment"]
    u, d, _ = np.linalg.svd((cov + cov.T) / 2)
    return names, u @ np.diag((d + eps) ** -0.5) @ u.T


def whitened(samples: DataFrame, s: str, value: str, names: list, matrix: np.ndarray, block: int = 1024) -> DataFrame:
    """O-SIG-16/18/19: samples times the matrix, a matrix product for each block of samples. A sample that lacks one of the channels counts 0 there."""
    shared = samples.sparkSession.sparkContext.broadcast(matrix)  # channels squared numbers of one probe
    rows = samples.filter(F.col("ch").isin(names)).select("ch", s, F.col(value).cast("double").alias(value), F.floor(F.col(s) / block).alias("_b"))
    schema = rows.select("ch", s, value).schema

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index=s, columns="ch", values=value).reindex(columns=names).fillna(0.0)
        out = wide.to_numpy() @ shared.value.T
        return pd.DataFrame({"ch": names * len(wide), s: np.repeat(wide.index.to_numpy(), len(names)), value: out.ravel()})

    return rows.groupBy("_b").applyInPandas(product, schema)


def drift_corrected(samples: DataFrame, s: str, value: str, names: list, depths: list[float], shifts: DataFrame, batch: int, sigma: float) -> DataFrame:
    """O-SIG-19: samples moved back by the depth shift of their batch (shifts: batch, shift), by drift_kernel() of the probe's channels; batches without one stay."""
    rows = samples.filter(F.col("ch").isin(names)).select("ch", s, F.col(value).cast("double").alias(value), F.floor(F.col(s) / batch).alias("batch"), F.floor(F.col(s) / min(batch, 1024)).alias("_b"))
    rows = rows.join(shifts.select("batch", F.col("shift").cast("double").alias("_shift")), "batch", "left")
    schema = rows.select("ch", s, value).schema

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        shift = pdf["_shift"].iloc[0]
        if pd.isna(shift) or shift == 0:
            return pdf[["ch", s, value]]
        wide = pdf.pivot(index=s, columns="ch", values=value).reindex(columns=names).fillna(0.0)
        out = wide.to_numpy() @ drift_kernel(depths, float(shift), sigma).T
        return pd.DataFrame({"ch": names * len(wide), s: np.repeat(wide.index.to_numpy(), len(names)), value: out.ravel()})

    return rows.groupBy("batch", "_b").applyInPandas(move, schema)


def drift_kernel(depths: list[float], shift: float, sigma: float) -> np.ndarray:
    """O-SIG-19: Gaussian interpolation from channels shifted along depth back onto the grid."""
    y = np.asarray(depths)
    k = lambda a, b: np.exp(-((a[:, None] - b[None, :]) ** 2) / (2 * sigma**2))
    return np.linalg.solve(k(y, y) + 0.01 * np.eye(len(y)), k(y, y + shift)).T


def moving(samples: DataFrame, keys: list[str], s: str, value: str, reach: int, how: str, chunk: int = 4096) -> DataFrame:
    """O-SIG-21: minimum, maximum or sum over the samples at most `reach` away in s, within chunks with a halo: each row is copied for a neighbouring chunk at most."""
    fn = {"min": F.min, "max": F.max, "sum": F.sum}[how]
    rows = with_halo(samples, s, max(chunk, reach), reach)
    window = Window.partitionBy(*keys, "chunk").orderBy(s).rangeBetween(-reach, reach)
    return rows.withColumn(how, fn(value).over(window)).filter("core").drop("chunk", "core")


def rms(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """O-SIG-22: root of the mean square."""
    return samples.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def channel_correlation(samples: DataFrame, s: str, value: str) -> DataFrame:
    """O-SIG-22: ch, other, r of all channel pairs, from gram()'s sums; null for a constant channel."""
    return gram(samples, s, value, []).filter("ch != other").select("ch", "other", _correlation().alias("r"))


def current_source_density(samples: DataFrame, keys: list[str], depth: str, s: str, value: str) -> DataFrame:
    """O-SIG-23: minus the second difference over depth of traces without their mean; the outer contacts have none. A key's contacts at one sample are few."""
    mean = samples.groupBy(*keys, depth).agg(F.avg(value).alias("_m"))
    w = Window.partitionBy(*keys, s).orderBy(depth)
    flat = samples.join(mean, [*keys, depth]).withColumn("_v", F.col(value) - F.col("_m"))
    csd: Column = -(F.lag("_v").over(w) - 2 * F.col("_v") + F.lead("_v").over(w))
    return flat.withColumn("csd", csd).filter("csd IS NOT NULL").select(*keys, depth, s, "csd")


def time_offset(a: DataFrame, b: DataFrame, s: str, value: str, reach: int) -> DataFrame:
    """O-SIG-22: the shift of b (up to reach samples) with the largest sum of products; ties go to the smallest shift in size."""
    moved = b.select(F.col(s).alias("_s"), F.col(value).alias("_w")).withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(s, F.col("_s") + F.col("shift"))
    scored = a.select(s, F.col(value).alias("_v")).join(moved, s).groupBy("shift").agg(F.sum(F.col("_v") * F.col("_w")).alias("score"))
    return scored.orderBy(F.desc("score"), F.abs("shift"), "shift").limit(1)
