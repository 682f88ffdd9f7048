"""Template matching and merging: matched filters and pursuit by chunk, seeding, fits of autocorrelograms, merge decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import checkpointed
from .signals import with_halo
from .units import close_pairs, correlogram, correlogram_metrics, merge_groups, template_similarity


def template_array(templates: DataFrame, channels: list, size: int) -> tuple[list, np.ndarray]:
    """Units and their templates [unit, channel, lag] of a table unit, ch, lag (0 to size - 1), value: channels x size numbers a unit of one probe or partition."""
    packed = templates.filter(F.col("ch").isin(channels)).groupBy("unit").agg(F.collect_list(F.struct("ch", "lag", "value")).alias("cells"))
    alone = templates.select("unit").distinct().join(packed, "unit", "left").orderBy("unit")
    units, arrays, ch = [], [], {c: i for i, c in enumerate(channels)}
    for r in alone.toLocalIterator():
        w = np.zeros((len(channels), size), dtype=np.float32)
        for c in r.cells or []:
            w[ch[c.ch], c.lag] = c.value
        units.append(r.unit)
        arrays.append(w)
    return units, np.stack(arrays).astype(float) if arrays else np.zeros((0, len(channels), size))


def matched(samples: DataFrame, templates: DataFrame, s: str, value: str, channels: list, size: int, threshold: float, chunk: int = 4096, peels: int = 1) -> DataFrame:
    """O-SRT-04/14: unit, s (of the template's first sample), amplitude of detections.

    Each round takes, in every chunk, the local maxima over templates and `size` samples of the least-squares gain
    b**2 / |w|**2 above threshold**2, where b is the correlation with template w; with more `peels` their contribution is
    subtracted and the rest matched again. A detection counts in the chunk that holds its first sample; the halo is four templates long.
    """
    units, w = template_array(templates, channels, size)
    norm = (w**2).sum(axis=(1, 2))
    halo = 4 * size
    rows = with_halo(samples.filter(F.col("ch").isin(channels)).select("ch", s, F.col(value).cast("double").alias("v")), s, chunk, halo)
    unit_kind = templates.schema["unit"].dataType.simpleString()
    order = {c: i for i, c in enumerate(channels)}

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        first, last = int(pdf[s].min()), int(pdf[s].max())
        x = np.zeros((len(channels), last - first + 1))
        x[pdf["ch"].map(order).to_numpy(), pdf[s].to_numpy() - first] = pdf["v"].to_numpy()
        core = (int(pdf["chunk"].iloc[0]) * chunk, (int(pdf["chunk"].iloc[0]) + 1) * chunk)
        found = []
        for _ in range(peels):
            if x.shape[1] < size:
                break
            b = np.stack([sum(np.correlate(x[c], t[c], mode="valid") for c in range(len(channels))) for t in w])
            gain = np.where(b > 0, b**2 / np.maximum(norm, 1e-12)[:, None], 0.0)
            best = gain.max(axis=0)
            padded = np.pad(best, size, constant_values=-1)
            top = np.lib.stride_tricks.sliding_window_view(padded, 2 * size + 1).max(axis=1)
            hits = np.flatnonzero((best > threshold**2) & (best == top))
            if not len(hits):
                break
            for i in hits:
                u = int(gain[:, i].argmax())
                a = b[u, i] / norm[u]
                x[:, i : i + size] -= a * w[u]
                found.append((units[u], first + int(i), float(a)))
        found = [r for r in found if core[0] <= r[1] < core[1]]
        return pd.DataFrame({"unit": [r[0] for r in found], "s": np.array([r[1] for r in found], dtype=np.int64), "amplitude": np.array([r[2] for r in found], dtype=float)})

    return rows.groupBy("chunk").applyInPandas(detect, f"unit {unit_kind}, s long, amplitude double")


def seeds(points: DataFrame, point_id: str, vector: str, k: int, tries: int = 100, seed: int = 1) -> list[int]:
    """O-SRT-11: ids of at most k centres. Each round draws `tries` points with chances in proportion to their unexplained energy |x|**2 - e (e: the best of
    2 x.c - |c|**2 over the centres so far, 0 at least) and takes the one that explains most more over all points; ties go to the least id.

    Chances come from hashes of id, round and seed (the least -log(u) / weight), so runs agree. A round is two passes that each return
    a bounded number of rows from a task; it ends early when nothing is left to explain.
    """
    spark = points.sparkSession
    rows = checkpointed(points.select(F.col(point_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).filter("x IS NOT NULL"))
    chosen: list[tuple[int, list[float]]] = []

    def explained(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.maximum((2 * x @ centres.T - (centres**2).sum(1)).max(axis=1, initial=0.0), 0.0)

    while len(chosen) < k:
        shared = spark.sparkContext.broadcast(np.array([c[1] for c in chosen]))

        def draw(batches, shared=shared):
            best = pd.DataFrame({"id": [], "x": [], "key": []})
            for pdf in batches:
                x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
                left = np.round((x**2).sum(1) - (explained(x, shared.value) if len(shared.value) else 0.0), 9)
                some = left > 0
                own = pd.DataFrame({"id": pdf["id"][some], "x": pdf["x"][some], "key": pdf["u"][some] / left[some]})
                best = pd.concat([best, own] if len(best) else [own]).nsmallest(tries, ["key", "id"])
            yield best.astype({"id": "int64", "x": object, "key": "float64"})

        u = (F.pmod(F.xxhash64("id", F.lit(len(chosen)), F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
        drawn = rows.withColumn("u", -F.log(u)).mapInPandas(draw, "id long, x array<double>, key double").orderBy("key", "id").limit(tries).collect()
        if not drawn:
            break
        drawn.sort(key=lambda r: r.id)
        candidates = spark.sparkContext.broadcast(np.array([r.x for r in drawn]))

        def gain(batches, shared=shared, candidates=candidates):
            total = np.zeros(len(candidates.value))
            for pdf in batches:
                x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
                now = explained(x, shared.value) if len(shared.value) else np.zeros(len(x))
                total += np.maximum(2 * x @ candidates.value.T - (candidates.value**2).sum(1) - now[:, None], 0.0).sum(axis=0)
            yield pd.DataFrame({"at": np.arange(len(total)), "gain": total})

        gains = {r["at"]: r["g"] for r in rows.mapInPandas(gain, "at long, gain double").groupBy("at").agg(F.round(F.sum("gain"), 6).alias("g")).collect()}  # `tries` rows
        best = min(gains, key=lambda i: (-gains[i], i))
        if gains[best] <= 0:
            break
        chosen.append((drawn[best].id, drawn[best].x))
    return [c[0] for c in chosen]


def damped_fit(model, x: np.ndarray, y: np.ndarray, start, low: np.ndarray, high: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Parameters within bounds and the squared error of a least-squares fit of model(parameters, x) to y, by damped Gauss-Newton steps."""
    p, damp = np.clip(np.asarray(start, dtype=float), low, high), 1e-2
    error = ((y - model(p, x)) ** 2).sum()
    for _ in range(rounds):
        step = 1e-5 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(model(p + step * (np.arange(len(p)) == i), x) - model(p, x)) / step[i] for i in range(len(p))], axis=1)
        move = np.linalg.solve(jac.T @ jac + damp * np.diag((jac**2).sum(0) + 1e-9), jac.T @ (y - model(p, x)))
        new = np.clip(p + move, low, high)
        e = ((y - model(new, x)) ** 2).sum()
        p, error, damp = (new, e, damp / 3) if e < error else (p, error, damp * 4)
        if damp > 1e12:
            break
    return p, float(error)


def fit_acg(acg: DataFrame, keys: list[str], bin_ms: float, rounds: int = 60) -> DataFrame:
    """O-CCG-07: keys, tau_decay, tau_rise, r2 of max(c * (exp(-(x - t0) / tau_decay) - d * exp(-(x - t0) / tau_rise)) + rate, 0) on the positive lags, by damped least squares with bounded parameters."""
    # Bounds of tau_decay, tau_rise, c, d, t0, rate, and where their fit starts.
    low = np.array([1.0, 0.1, 0.0, 0.0, 0.0, 0.0])
    high = np.array([500.0, 50.0, 500.0, 15.0, 5.0, 100.0])
    start = [20.0, 1.0, 5.0, 1.0, 0.5]

    def model(p: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x - p[4], 0)
        return np.maximum(p[2] * (np.exp(-z / p[0]) - p[3] * np.exp(-z / p[1])) + p[5], 0)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["bin"] > 0].sort_values("bin")
        x, y = own["bin"].to_numpy() * bin_ms, own["n"].to_numpy(dtype=float)
        scale = y.max() if len(y) and y.max() > 0 else 1.0
        y = y / scale * 10
        p, error = damped_fit(model, x, y, [*start, max(y.mean(), 0.1) if len(y) else 0.1], low, high, rounds if len(y) > 6 else 0)
        total = ((y - y.mean()) ** 2).sum() if len(y) else 0.0
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"tau_decay": [p[0]], "tau_rise": [p[1]], "r2": [1 - error / total if total else 0.0]})

    schema = acg.select(*keys).schema.add("tau_decay", "double").add("tau_rise", "double").add("r2", "double")
    return acg.select(*keys, "bin", "n").groupBy(*keys).applyInPandas(fit, schema)


def merge_candidates(spikes: DataFrame, templates: DataFrame, t: str, vector: str, similar: float, bin_width, n_bins: int, far: tuple[int, int], near: tuple[int, int], centres: int, r_limit: float = 0.25, q_limit: float = 0.05) -> DataFrame:
    """O-SRT-15/24, O-CL-06: unit, other, similarity, r, q of similar templates whose cross-correlogram has the dip of one neuron.

    Only spikes of similar pairs meet: each spike is copied to the pairs that its unit belongs to.
    """
    alike = template_similarity(templates, "unit", vector).filter(F.col("similarity") >= similar)
    a = spikes.join(alike.select("unit", "other"), "unit").select("unit", "other", t)
    b = spikes.select(F.col("unit").alias("other"), t).join(alike.select("unit", "other"), "other").select("unit", "other", t)
    met = close_pairs(a, b, ["unit", "other"], t, bin_width * n_bins + bin_width / 2)
    lag = F.rint((F.col(f"b_{t}") - F.col(t)) / bin_width).cast("long")
    counts = met.groupBy("unit", "other", lag.alias("bin")).agg(F.count(F.lit(1)).alias("n")).filter(F.abs("bin") <= n_bins)
    grid = alike.select("unit", "other").withColumn("bin", F.explode(F.sequence(F.lit(-n_bins).cast("long"), F.lit(n_bins).cast("long"))))
    dense = grid.join(counts, ["unit", "other", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    scored = correlogram_metrics(dense, ["unit", "other"], far, near, centres)
    return alike.join(scored, ["unit", "other"]).filter(F.coalesce((F.col("r") < r_limit) & (F.col("q") < q_limit), F.lit(False)))


def template_shifts(templates: DataFrame, pairs: DataFrame, reach: int) -> DataFrame:
    """O-SRT-15: unit, other, shift (samples that other's template lies later, up to reach), similarity: the greatest cosine over shifts of two templates (unit, ch, lag, value); ties go to the smallest shift in size."""
    norm = templates.groupBy("unit").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n"))
    a = pairs.join(templates, "unit").select("unit", "other", "ch", "lag", F.col("value").alias("_v"))
    b = pairs.join(templates.withColumnRenamed("unit", "other"), "other").withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).select("unit", "other", "ch", (F.col("lag") - F.col("shift")).alias("lag"), "shift", F.col("value").alias("_w"))
    score = a.join(b, ["unit", "other", "ch", "lag"]).groupBy("unit", "other", "shift").agg(F.sum(F.col("_v") * F.col("_w")).alias("_s"))
    best = score.groupBy("unit", "other").agg(F.max_by(F.struct("shift", "_s"), F.struct(F.round("_s", 9), -F.abs("shift"), -F.col("shift"))).alias("_b"))
    sized = best.join(norm, "unit").join(norm.select(F.col("unit").alias("other"), F.col("_n").alias("_m")), "other")
    return sized.select("unit", "other", F.col("_b.shift").alias("shift"), (F.col("_b._s") / ((F.col("_n") + 1e-6) * (F.col("_m") + 1e-6))).alias("similarity"))


def merged_units(spikes: DataFrame, candidates: DataFrame, t: str | None = None, shifts: DataFrame | None = None) -> DataFrame:
    """O-SRT-15, O-CL-06: spikes with their unit replaced by the least unit of its merge group. With shifts (unit, other, shift) times move so that the templates
    of the group lie over that of its least unit; a member without a shift of its own to the least unit stays where it is.
    """
    groups = merge_groups(candidates.select("unit", "other")).select(F.col("node").alias("unit"), F.col("group").alias("_g"))
    out = spikes.join(groups, "unit", "left")
    if shifts is not None:
        moves = shifts.select(F.col("unit").alias("_g"), F.col("other").alias("unit"), F.col("shift").alias("_d"))
        out = out.join(moves, ["_g", "unit"], "left").withColumn(t, F.col(t) - F.coalesce("_d", F.lit(0))).drop("_d")
    return out.withColumn("unit", F.coalesce("_g", "unit")).drop("_g")


def merged_templates(templates: DataFrame, spikes: DataFrame, candidates: DataFrame, shifts: DataFrame) -> DataFrame:
    """O-SRT-15: unit, ch, lag, value: the templates of each merge group, shifted over that of its least unit, as a mean weighted by spikes."""
    n = spikes.groupBy("unit").agg(F.count(F.lit(1)).alias("_k"))
    groups = merge_groups(candidates.select("unit", "other")).select(F.col("node").alias("unit"), F.col("group").alias("_g"))
    weight = n.join(groups, "unit", "left").select(F.coalesce("_g", "unit").alias("_g"), "unit", "_k")
    moves = shifts.select(F.col("unit").alias("_g"), F.col("other").alias("unit"), F.col("shift").alias("_d"))
    own = templates.join(weight, "unit").join(moves, ["_g", "unit"], "left").withColumn("lag", F.col("lag") - F.coalesce("_d", F.lit(0)))
    total = weight.groupBy("_g").agg(F.sum("_k").alias("_t"))
    return own.groupBy("_g", "ch", "lag").agg(F.sum(F.col("value") * F.col("_k")).alias("_v")).join(total, "_g").select(F.col("_g").alias("unit"), "ch", "lag", (F.col("_v") / F.col("_t")).alias("value"))


def contamination_matrix(spikes: DataFrame, t: str, bin_width, n_bins: int, far: tuple[int, int], near: tuple[int, int], centres: int) -> DataFrame:
    """O-CCG-03/04: unit, r, q of each autocorrelogram, its zero lag left out."""
    acg = correlogram(spikes, spikes, t, bin_width, n_bins).filter("unit = other")
    return correlogram_metrics(acg, ["unit"], far, near, centres)


def depth_profile(samples: DataFrame, events: DataFrame, contacts: DataFrame, s: str, value: str, reach: int) -> DataFrame:
    """O-WV-06: ch, y, mean, deep: mean signal at the events' peaks, and whether its sign differs from that of the channel's lowest neighbour on the shank (polarity reversal)."""
    at = events.select(F.explode(F.sequence(F.col("peak") - reach, F.col("peak") + reach)).alias(s))
    mean = samples.join(at, s).groupBy("ch").agg(F.avg(value).alias("mean"))
    rows = mean.join(contacts.select("ch", "shank", "y"), "ch")
    first = F.first("mean").over(Window.partitionBy("shank").orderBy("y").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a shank's contacts: bounded
    return rows.withColumn("deep", F.signum("mean") != F.signum(first))


def _strongest(peaks: DataFrame, contacts: DataFrame, unit: str, amplitude: str, k: int) -> DataFrame:
    rows = peaks.join(contacts.select("ch", "x", "y"), "ch")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(amplitude), "ch"))).filter(F.col("_r") <= k).select(unit, F.col(amplitude).cast("double").alias("_a"), "x", "y", "_r")


def weighted_centre(peaks: DataFrame, contacts: DataFrame, unit: str, amplitude: str, k: int = 5) -> DataFrame:
    """O-WV-03: unit, x, y: centre of the k strongest contacts weighted by squared amplitude; where trilaterate() starts."""
    w = F.col("_a") * F.col("_a")
    return _strongest(peaks, contacts, unit, amplitude, k).groupBy(unit).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"))


#: Bounds of the amplitude, length constant and offset of an exponential fit over distance.
DECAY_LOW, DECAY_HIGH = np.array([1.0, 0.001, 0.0]), np.array([5000.0, 200.0, 1000.0])


def _decay(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return p[0] * np.exp(-x / p[1]) + p[2]


def trilaterate(peaks: DataFrame, contacts: DataFrame, unit: str, amplitude: str, k: int = 16, margin: float = 100.0) -> DataFrame:
    """O-WV-03: unit, x, y, length_constant: the place from which a * exp(-distance / b) + c fits the amplitudes of the k strongest contacts best, at
    most `margin` beyond them, and b of the same curve fitted to the sorted amplitudes over the sorted distances of all contacts from there. Null with fewer than three contacts.
    """
    rows = _strongest(peaks, contacts, unit, amplitude, k)
    places = contacts.select("x", "y").orderBy("x", "y").collect()  # a probe's contacts
    grid = np.array([[r.x, r.y] for r in places])
    kind = peaks.schema[unit].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        at, y = pdf[["x", "y"]].to_numpy(), pdf["_a"].to_numpy()
        out = {unit: [pdf[unit].iloc[0]], "x": [None], "y": [None], "length_constant": [None]}
        if len(y) >= 3:
            weight = y**2 / max((y**2).sum(), 1e-300)
            low, high = np.append(at.min(0) - margin, DECAY_LOW), np.append(at.max(0) + margin, DECAY_HIGH)
            p, _ = damped_fit(lambda p, x: _decay(p[2:], np.hypot(x[:, 0] - p[0], x[:, 1] - p[1])), at, y, [*(weight @ at), y.max(), 30.0, 5.0], low, high, 200)
            gaps = np.sort(np.hypot(grid[:, 0] - p[0], grid[:, 1] - p[1]))[: len(y)]
            b, _ = damped_fit(_decay, gaps, y, [y.max(), 30.0, 5.0], DECAY_LOW, DECAY_HIGH, 200)
            out |= {"x": [p[0]], "y": [p[1]], "length_constant": [b[1]]}
        return pd.DataFrame(out).astype({"x": float, "y": float, "length_constant": float})

    return rows.groupBy(unit).applyInPandas(fit, f"{unit} {kind}, x double, y double, length_constant double")
