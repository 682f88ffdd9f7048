"""Waveforms and features: means around spikes, shape metrics, cluster quality in feature space, outlier splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_inverse, chi2_tail
from .ordered import checkpointed, range_join
from .units import pearson


def mean_waveforms(samples: DataFrame, spikes: DataFrame, s: str, value: str, before: int, after: int) -> DataFrame:
    """O-WV-01/05: unit, ch, lag, mean, deviation, n of samples around the unit's spikes; sums are combined on every task."""
    spans = spikes.select("unit", F.col(s).alias("_at"), (F.col(s) - before).alias("start"), (F.col(s) + after).alias("stop"))
    hits = range_join(samples.select("ch", s, value), spans, [], s, "start", "stop", max(before + after, 1))
    return hits.groupBy("unit", "ch", (F.col(s) - F.col("_at")).alias("lag")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count(F.lit(1)).alias("n"))


def best_channels(waves: DataFrame, k: int) -> DataFrame:
    """O-WIN-18, O-WV-05: unit, ch, ptp, rank of the k channels with the greatest peak-to-peak of the mean waveform."""
    ptp = waves.groupBy("unit", "ch").agg((F.max("mean") - F.min("mean")).alias("ptp"))
    return ptp.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("ptp"), "ch")).cast("long")).filter(F.col("rank") <= k)


def waveform_metrics(waves: DataFrame, rate: float, upsample: int = 8) -> DataFrame:
    """O-WV-02: unit, polarity, trough_to_peak (ms), ab_ratio, peak_to_trough of the mean waveform on its best channel, band-limited upsampling."""
    best = best_channels(waves, 1).select("unit", "ch")
    rows = waves.join(best, ["unit", "ch"]).select("unit", "lag", "mean")
    schema = rows.select("unit").schema.add("polarity", "double").add("trough_to_peak", "double").add("ab_ratio", "double").add("peak_to_trough", "double")

    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("lag")["mean"].to_numpy(dtype=float)
        n = len(y)
        z = (y - y.mean()) / (y.std() or 1.0)
        m = n * upsample
        f = np.fft.rfft(z)
        full = np.zeros(m // 2 + 1, dtype=complex)
        full[: len(f)] = f
        w = np.fft.irfft(full, m) * upsample
        polarity = 1.0 if abs(w.min()) >= w.max() else -1.0
        w = w * polarity
        trough = int(np.argmin(w))
        peak = trough + int(np.argmax(w[trough:]))
        a, b = w[: trough + 1].max(), w[trough:].max()
        ratio = (b - a) / (b + a) if b + a else 0.0
        return pd.DataFrame({"unit": [pdf["unit"].iloc[0]], "polarity": [polarity], "trough_to_peak": [(peak - trough) / upsample / rate * 1000], "ab_ratio": [ratio], "peak_to_trough": [float(w[peak] / abs(w[trough])) if w[trough] else 0.0]})

    return rows.groupBy("unit").applyInPandas(shape, schema)


def moments(features: DataFrame, unit: str, vector: str, size: int) -> DataFrame:
    """unit, n, mean (array), second (row-major array of mean products): every task adds up its rows' products by matrix products, so a unit and task exchange size**2 numbers."""
    kind = features.schema[unit].dataType.simpleString()

    def sums(batches):
        held: dict = {}
        for pdf in batches:
            x = np.array(pdf[vector].tolist(), dtype=float).reshape(len(pdf), size)
            for u, at in pdf.groupby(unit, dropna=False).indices.items():
                own = x[at]
                n, m, q = held.get(u, (0, 0.0, 0.0))
                held[u] = (n + len(own), m + own.sum(axis=0), q + own.T @ own)
        if held:  # a task without rows has no arrays to tell their type from
            yield pd.DataFrame({unit: list(held), "n": [v[0] for v in held.values()], "mean": [v[1] for v in held.values()], "second": [v[2].ravel() for v in held.values()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        return pd.DataFrame({unit: [pdf[unit].iloc[0]], "n": [n], "mean": [np.stack(pdf["mean"].tolist()).sum(axis=0) / n], "second": [np.stack(pdf["second"].tolist()).sum(axis=0) / n]})

    schema = f"`{unit}` {kind}, n long, mean array<double>, second array<double>"
    return features.select(unit, vector).filter(F.col(vector).isNotNull()).mapInPandas(sums, schema).groupBy(unit).applyInPandas(total, schema)


def distance_models(found: DataFrame, unit: str, size: int, ridge: float = 1e-6) -> DataFrame:
    """unit, n, mean, inverse: of moments() the inverse covariance after scaling each feature to a deviation of 1 and adding the ridge, scaled back."""
    kind = found.schema[unit].dataType.simpleString()

    def invert(batches):
        for pdf in batches:
            inverses = []
            for n, mean, second in zip(pdf["n"], pdf["mean"], pdf["second"], strict=True):
                cov = (np.asarray(second).reshape(size, size) - np.outer(mean, mean)) * (n / max(n - 1, 1))
                scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
                scale[scale == 0] = 1.0
                inverses.append((np.linalg.inv(cov / np.outer(scale, scale) + ridge * np.eye(size)) / np.outer(scale, scale)).ravel())
            yield pd.DataFrame({unit: pdf[unit], "n": pdf["n"], "mean": pdf["mean"], "inverse": inverses})

    return found.mapInPandas(invert, f"`{unit}` {kind}, n long, mean array<double>, inverse array<double>")


def own_distances(features: DataFrame, row_id: str, unit: str, vector: str, size: int) -> DataFrame:
    """row_id, unit, d2: the squared distance of each row to its own unit's distribution; rows meet their unit's model in a join of any size."""
    models = distance_models(moments(features, unit, vector, size), unit, size).select(unit, F.col("mean").alias("_m"), F.col("inverse").alias("_i"))
    kind = features.schema[unit].dataType.simpleString()

    def distances(batches):
        for pdf in batches:
            d2 = np.zeros(len(pdf))
            x = np.array(pdf[vector].tolist(), dtype=float).reshape(len(pdf), size)
            for at in pdf.groupby(unit).indices.values():
                y = x[at] - np.asarray(pdf["_m"].iloc[at[0]])
                d2[at] = np.einsum("ij,jk,ik->i", y, np.asarray(pdf["_i"].iloc[at[0]]).reshape(size, size), y)
            yield pd.DataFrame({row_id: pdf[row_id], unit: pdf[unit], "d2": d2})

    return features.select(row_id, unit, vector).join(models, unit).mapInPandas(distances, f"{row_id} long, `{unit}` {kind}, d2 double")


#: Units whose models are sent out at a time, and bins of log2 distance (64 an octave) in the search for a unit's n-th distance.
UNITS_AT_A_TIME = 512
_OCTAVES, _FINE = (-40, 60), 64


def _bins(d2: np.ndarray) -> np.ndarray:
    return np.clip(((np.log2(np.maximum(d2, 1e-300)) - _OCTAVES[0]) * _FINE).astype(np.int64), 0, (_OCTAVES[1] - _OCTAVES[0]) * _FINE - 1)


def isolation(features: DataFrame, unit: str, vector: str, size: int) -> DataFrame:
    """O-WV-04: unit, n, isolation (the n-th smallest distance of another unit's rows, n the unit's own; null with fewer) and l_ratio (sum of chi-square tails over n).

    Rows are compared with blocks of units, and what a task exchanges is a histogram of distances for each unit; a second pass
    takes the distances of the one bin that holds the n-th, no more than are needed from each task. No pair of row and unit is ever exchanged.
    """
    spark = features.sparkSession
    models = checkpointed(distance_models(moments(features, unit, vector, size), unit, size))
    kind = features.schema[unit].dataType.simpleString()
    rows = features.select(unit, vector).filter(F.col(vector).isNotNull())
    out = None
    held: list = []

    def blocks():
        for row in models.orderBy(unit).toLocalIterator():
            held.append((row[unit], row["n"], np.array(row["mean"]), np.array(row["inverse"]).reshape(size, size)))
            if len(held) == UNITS_AT_A_TIME:
                yield list(held)
                held.clear()
        if held:
            yield list(held)

    def others(pdf: pd.DataFrame, model) -> np.ndarray:
        x = np.array(pdf[vector].tolist(), dtype=float).reshape(len(pdf), size)
        y = x[(pdf[unit] != model[0]).to_numpy()] - model[2]
        return np.einsum("ij,jk,ik->i", y, model[3], y)

    for block in blocks():
        shared = spark.sparkContext.broadcast(block)

        def histogram(batches, shared=shared):
            counts = np.zeros((len(shared.value), (_OCTAVES[1] - _OCTAVES[0]) * _FINE), dtype=np.int64)
            tails = np.zeros(len(shared.value))
            for pdf in batches:
                for i, model in enumerate(shared.value):
                    d2 = others(pdf, model)
                    np.add.at(counts[i], _bins(d2), 1)
                    tails[i] += chi2_tail(d2, size).sum()
            at, bins = np.nonzero(counts)
            names = [m[0] for m in shared.value]
            yield pd.DataFrame({"unit": [names[i] for i in at] + names, "bin": np.append(bins, np.full(len(names), -1)), "n": np.append(counts[at, bins], np.zeros(len(names), np.int64)), "tail": np.append(np.zeros(len(at)), tails)})

        found = checkpointed(rows.mapInPandas(histogram, f"unit {kind}, bin long, n long, tail double").groupBy("unit", "bin").agg(F.sum("n").alias("n"), F.sum("tail").alias("tail")))
        own = spark.createDataFrame([(m[0], m[1]) for m in block], f"unit {kind}, own long")  # UNITS_AT_A_TIME rows
        upto = F.sum("n").over(Window.partitionBy("unit").orderBy("bin"))  # a unit's bins: bounded
        places = found.filter("bin >= 0").withColumn("_upto", upto).join(F.broadcast(own), "unit").filter("_upto >= own AND _upto - n < own").select("unit", "bin", (F.col("own") - F.col("_upto") + F.col("n")).alias("rank"))
        wanted = {r["unit"]: (r["bin"], r["rank"]) for r in places.collect()}  # UNITS_AT_A_TIME rows at most
        targets = spark.sparkContext.broadcast(wanted)

        def nearest(batches, shared=shared, targets=targets):
            best: dict = {}
            for pdf in batches:
                for model in shared.value:
                    if model[0] in targets.value:
                        place, rank = targets.value[model[0]]
                        d2 = others(pdf, model)
                        d2 = np.append(best.get(model[0], np.zeros(0)), d2[_bins(d2) == place])
                        best[model[0]] = np.partition(d2, rank - 1)[:rank] if len(d2) > rank else d2
            yield pd.DataFrame({"unit": [u for u, d in best.items() for _ in d], "d2": np.concatenate([*best.values(), np.zeros(0)])})

        ranks = spark.createDataFrame([(u, r) for u, (_, r) in wanted.items()], f"unit {kind}, rank long")
        ranked = rows.mapInPandas(nearest, f"unit {kind}, d2 double").withColumn("_r", F.row_number().over(Window.partitionBy("unit").orderBy("d2")))
        nth = ranked.join(F.broadcast(ranks), "unit").filter("_r = rank").select("unit", F.col("d2").alias("isolation"))
        tails = found.filter("bin = -1").select("unit", "tail")
        part = checkpointed(own.join(nth, "unit", "left").join(tails, "unit", "left").select("unit", F.col("own").alias("n"), "isolation", (F.coalesce("tail", F.lit(0.0)) / F.col("own")).alias("l_ratio")))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"unit {kind}, n long, isolation double, l_ratio double") if out is None else out


def outlier_split(
    features: DataFrame, waves: DataFrame, row_id: str, unit: str, vector: str, size: int, contamination: float = 0.05, adaptive: bool = False, min_clean: float = 0.5, relax: float = 0.5,
    rescue_cosine: float | None = 0.9, mad_scale: float = 3.0, min_rows: int = 10,
) -> DataFrame:
    """O-CL-05: row_id, unit, outlier, new_unit (dense numbers from 0; null for discarded rows).

    A unit's outliers lie beyond the quantile 1 - contamination of its distances, or with `adaptive` beyond the chi-square quantile
    scaled by the median distance over the chi-square median; if fewer than min_clean of the rows would stay, with contamination * relax. An
    outlier is rescued if its demeaned wave (waves: row_id, wave, an array of one best channel) has at least that cosine with the mean wave of the others and its peak-to-peak
    lies within mad_scale median deviations of their median. Units of fewer than min_rows rows are discarded; so are outliers of a unit that are fewer, others become a new unit after their own.
    """
    d = F.sqrt("d2")
    own = checkpointed(own_distances(features, row_id, unit, vector, size).select(row_id, F.col(unit).alias("unit"), d.alias("d")))
    both = [contamination, max(1e-4, contamination * relax)]
    if adaptive:
        mid = F.percentile("d", F.lit(0.5))
        cuts = [(mid * float(np.sqrt(chi2_inverse(1 - c, size) / chi2_inverse(0.5, size)))).alias(f"_c{i}") for i, c in enumerate(both)]
    else:
        cuts = [F.percentile("d", F.lit(1 - c)).alias(f"_c{i}") for i, c in enumerate(both)]
    limits = own.groupBy("unit").agg(F.count(F.lit(1)).alias("_n"), *cuts)
    kept = own.join(limits, "unit").groupBy("unit").agg((F.count_if(F.col("d") <= F.col("_c0")) / F.count(F.lit(1))).alias("_clean"))
    limits = limits.join(kept, "unit").select("unit", "_n", F.when(F.col("_clean") < min_clean, F.col("_c1")).otherwise(F.col("_c0")).alias("_cut"))
    rows = own.join(limits, "unit").filter(F.col("_n") >= min_rows).withColumn("outlier", F.col("d") > F.col("_cut")).select(row_id, "unit", "outlier")
    if rescue_cosine is not None:
        wave = F.col("wave").cast("array<double>")
        rows = rows.join(waves.select(row_id, wave.alias("_w"), (F.array_max(wave) - F.array_min(wave)).alias("_a")), row_id, "left")
        clean = rows.filter(~F.col("outlier") & F.col("_w").isNotNull())
        mean = clean.select("unit", F.posexplode("_w").alias("_p", "_x")).groupBy("unit", "_p").agg(F.avg("_x").alias("_x")).groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda v: v["_x"]).alias("_t"))
        middle = clean.groupBy("unit").agg(F.median("_a").alias("_mid"), F.count(F.lit(1)).alias("_k"))
        mad = clean.join(middle, "unit").groupBy("unit").agg(F.greatest(mad_scale * F.median(F.abs(F.col("_a") - F.col("_mid"))), F.lit(1e-6)).alias("_tol"))
        rows = rows.join(mean, "unit", "left").join(middle, "unit", "left").join(mad, "unit", "left")
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
        flat = lambda v: F.transform(v, lambda x: x - total(v) / F.size(v))
        a, b = flat(F.col("_w")), flat(F.col("_t"))
        product = lambda u, v: total(F.zip_with(u, v, lambda x, y: x * y))
        cosine = product(a, b) / ((F.sqrt(product(a, a)) + 1e-12) * (F.sqrt(product(b, b)) + 1e-12))
        saved = (F.col("_k") > 10) & (cosine >= rescue_cosine) & (F.abs(F.col("_a") - F.col("_mid")) <= F.col("_tol"))
        rows = rows.withColumn("outlier", F.col("outlier") & ~F.coalesce(saved, F.lit(False))).select(row_id, "unit", "outlier")
    rows = checkpointed(rows)
    sizes = rows.groupBy("unit", "outlier").agg(F.count(F.lit(1)).alias("_n")).filter(~F.col("outlier") | (F.col("_n") >= min_rows))
    number = sizes.groupBy(F.lit(0).alias("_all")).agg(F.array_sort(F.collect_list(F.struct("unit", "outlier"))).alias("_l")).select(F.posexplode("_l").alias("new_unit", "_g")).select("_g.*", "new_unit")  # two rows a unit
    gone = features.select(row_id, F.col(unit).alias("unit")).join(rows.select(row_id), row_id, "left_anti").select(row_id, "unit", F.lit(False).alias("outlier"), F.lit(None).cast("int").alias("new_unit"))
    return rows.join(number, ["unit", "outlier"], "left").select(row_id, "unit", "outlier", "new_unit").unionByName(gone)


def principal_axes(features: DataFrame, vector: str, size: int, k: int) -> np.ndarray:
    """O-SRT-02, O-WV-04: the first k principal axes (rows) of all rows, from one aggregate of size**2 sums; the largest entry of each is positive."""
    row = moments(features.withColumn("_all", F.lit(0)), "_all", vector, size).first()
    mean = np.array(row["mean"])
    _, axes = np.linalg.eigh(np.array(row["second"]).reshape(size, size) - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :k].T
    return axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])[:, None]


def projected(features: DataFrame, vector: str, axes: np.ndarray, out: str = "pc") -> DataFrame:
    """features with their coordinates on the axes, in built-in arithmetic."""
    x = F.col(vector).cast("array<double>")
    one = lambda a: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in a]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return features.withColumn(out, F.array(*[one(a) for a in axes]))


def bimodal_split(features: DataFrame, row_id: str, unit: str, vector: str, size: int, rounds: int = 50, least: int = 300, share: float = 0.05, sure: float = 0.9, alike: float = 0.9, even: float = 0.2) -> DataFrame:
    """O-SRT-25: row_id, unit, side (0 or 1), split: every unit's rows in two classes along the direction in which they are most bimodal, and whether the unit should be split so.

    A mixture of two Gaussians is fitted to each unit's projections on one direction, from the tenth round on the direction itself, too. A round adds up, for each unit,
    the first class's weight, weighted sum and weighted products of the rows: size**2 numbers a unit and task; parameters of all units go back to the tasks.
    A unit is split if it has `least` rows, each side has more than that share and `least` of them, both sides' mean confidence exceeds `sure`, and their
    means aren't both correlated above `alike` and within `even` of each other's length.
    """
    spark = features.sparkSession
    kind = features.schema[unit].dataType.simpleString()
    rows = checkpointed(features.select(row_id, F.col(unit).alias("unit"), F.col(vector).cast("array<double>").alias("x")).filter("x IS NOT NULL"))
    held: dict = {}
    for r in moments(rows, "unit", "x", size).toLocalIterator():
        mean, second = np.array(r["mean"]), np.array(r["second"]).reshape(size, size)
        cov = second - np.outer(mean, mean)
        if r["n"] >= least:
            w = np.linalg.eigh(cov)[1][:, -1]
            held[r["unit"]] = {"n": r["n"], "mean": mean, "all": cov * r["n"], "w": w * np.sign(w[np.abs(w).argmax()]), "class": None}

    def first_class(model, y: np.ndarray) -> np.ndarray:
        x = y @ model["w"]
        if model["class"] is None:  # begin with the two sides of the mean
            return (x > 0).astype(float)
        p, m1, m2, s1, s2 = model["class"]
        a = -0.5 * np.log(s1) - (x - m1) ** 2 / (2 * s1) + np.log(max(p, 1e-12))
        b = -0.5 * np.log(s2) - (x - m2) ** 2 / (2 * s2) + np.log(max(1 - p, 1e-12))
        return 1 / (1 + np.exp(np.clip(b - a, -700, 700)))

    def weighed(model):
        def sums(batches):
            total: dict = {}
            for pdf in batches:
                x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), size)
                for u, at in pdf.groupby("unit").indices.items():
                    if u in model.value:
                        y = x[at] - model.value[u]["mean"]
                        r = first_class(model.value[u], y)
                        part = np.concatenate([[r.sum()], r @ y, ((y * r[:, None]).T @ y).ravel()])
                        total[u] = total.get(u, 0.0) + part
            yield pd.DataFrame({"unit": list(total), "sums": list(total.values())}).astype({"sums": object})

        return sums

    for turn in range(rounds if held else 0):
        shared = spark.sparkContext.broadcast(held)
        found: dict = {}
        for r in rows.select("unit", "x").mapInPandas(weighed(shared), f"unit {kind}, sums array<double>").toLocalIterator():  # a row a unit and task
            found[r["unit"]] = found.get(r["unit"], 0.0) + np.array(r["sums"])
        for u, total in found.items():
            model = held[u]
            n, r1, v1, q1 = model["n"], total[0], total[1 : 1 + size], total[1 + size :].reshape(size, size)
            r2, v2, q2 = n - r1, -v1, model["all"] - q1  # rows are centred
            if min(r1, r2) < 1e-6 * n:
                continue

            def spread(w, v, q, r):
                return max(float(w @ q @ w) / r - (float(w @ v) / r) ** 2, 1e-12)

            w = model["w"]
            s1, s2, m1, m2 = spread(w, v1, q1, r1), spread(w, v2, q2, r2), float(w @ v1) / r1, float(w @ v2) / r2
            if turn > 10 and turn % 2:
                w = np.linalg.solve(q1 / s1 + q2 / s2 + 1e-9 * np.eye(size), v1 * m1 / s1 + v2 * m2 / s2)
                w = w / max(np.linalg.norm(w), 1e-300)
            held[u] = model | {"w": w, "class": (r1 / n, m1, m2, s1, s2)}
    shared = spark.sparkContext.broadcast(held)

    def sides(batches):
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), size)
            r = np.ones(len(pdf))
            for u, at in pdf.groupby("unit").indices.items():
                if u in shared.value:
                    r[at] = first_class(shared.value[u], x[at] - shared.value[u]["mean"])
            yield pd.DataFrame({row_id: pdf[row_id], "unit": pdf["unit"], "side": np.where(r > 0.5, 0, 1).astype(np.int32), "sure": np.maximum(r, 1 - r), "x": pdf["x"]})

    found = checkpointed(rows.mapInPandas(sides, f"{row_id} long, unit {kind}, side int, sure double, x array<double>"))
    means = found.select("unit", "side", F.posexplode("x").alias("p", "v")).groupBy("unit", "p").agg(*[F.avg(F.when(F.col("side") == i, F.col("v"))).alias(f"m{i}") for i in (0, 1)])
    length = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    means = means.groupBy("unit").agg(pearson(F.col("m0"), F.col("m1")).alias("_c"), (2 * F.abs(length("m0") - length("m1")) / F.nullif(length("m0") + length("m1"), F.lit(0.0))).alias("_e"))
    of = lambda i, f: f(F.when(F.col("side") == i, F.col("sure")))
    sizes = found.groupBy("unit").agg(F.count(F.lit(1)).alias("_n"), *[of(i, F.count).alias(f"_k{i}") for i in (0, 1)], *[of(i, F.avg).alias(f"_p{i}") for i in (0, 1)])
    smaller = F.least("_k0", "_k1")
    good = (F.col("_n") >= least) & (smaller >= least) & (smaller > share * F.col("_n")) & (F.least("_p0", "_p1") > sure) & ~((F.col("_c") > alike) & (F.col("_e") < even))
    verdict = sizes.join(means, "unit").select("unit", F.coalesce(good, F.lit(False)).alias("split"))
    return found.select(row_id, "unit", "side").join(verdict, "unit").select(row_id, "unit", "side", "split")
