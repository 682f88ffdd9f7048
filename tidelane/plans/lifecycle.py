"""Whole runs put together from operators: staging, state scoring, sorting, post-processing.

Every step's result is a Parquet table in the session's folder. A step whose table is complete is read, not run again, so a run that
lost its driver goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import intervals as iv
from ..operators import joins as jn
from ..operators import partitions as pt
from ..operators import results as rs
from ..operators import sequences as sq
from ..operators import signals as sg
from ..operators import sorting as so
from ..operators import states as ss
from ..operators import units as un
from ..sources.sinks import write_frames
from .config import NoiseRules, StateSettings


@dataclass
class Session:
    """A folder of tables. overwrite names steps that run again, '*' all."""

    spark: SparkSession
    path: str
    overwrite: frozenset[str] = frozenset()
    ran: list[str] = field(default_factory=list)

    def complete(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """O-CL-08: the step's table: stored, or made and stored now."""
        if not self.complete(name) or {name, "*"} & self.overwrite:
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
            self.ran.append(name)
        return self.spark.read.parquet(f"{self.path}/{name}")


def stage_sessions(session: Session, epochs: DataFrame, rate: float) -> DataFrame:
    """O-UNI-02/05, O-SUP-12/22: epochs (session, folder, order, n_samples, n_channels, rate) that agree in channels and rate, numbered in order with their places in the whole; kept as `epochs`."""
    one = rs.check_sources(epochs.withColumn("_all", F.lit("the sessions")), ["_all"]).drop("_all")
    numbered = pt.mergepoints(one, [], "order", "n_samples", rate)
    return session.step("epochs", lambda: numbered)


def preprocess(session: Session, samples: DataFrame, s: str, value: str, rate: float, contacts: DataFrame, low: float, high: float, reference: str | None = "common", lfp_rate: float | None = None) -> dict[str, DataFrame]:
    """run of O-SIG-01/05, O-SIG-03, O-SNK-03/11: referenced and filtered samples of the contacts' channels, and the slow signal. Other channels pass unchanged."""
    own = samples.join(contacts.select("ch"), "ch", "left_semi")
    rest = samples.join(contacts.select("ch"), "ch", "left_anti")

    def clean() -> DataFrame:
        flat = sg.common_reference(own, [], s, value) if reference == "common" else sg.local_reference(own, contacts, s, value, 0.0, 200.0) if reference == "local" else own
        return sg.filtered(flat, ["ch"], s, value, low, high, rate).unionByName(rest.select("ch", s, F.col(value).cast("double").alias(value)))

    out = {"samples": session.step("samples", clean)}
    if lfp_rate:
        out["lfp"] = session.step("lfp", lambda: sg.lfp(samples, ["ch"], s, value, rate, lfp_rate))
    return out


def write_preprocessed(samples: DataFrame, path: str, chunk: int = 30_000) -> None:
    """O-SNK-03/11: samples (ch, s, v) as chunks of interleaved 16-bit numbers."""
    write_frames(samples, path, chunk)


def score_states(session: Session, samples: DataFrame, s: str, value: str, rate: float, emg_channels: list, settings: StateSettings | None = None, freqs: list[float] | None = None, window: int = 2) -> dict[str, DataFrame]:
    """O-ST-14: scores, states, intervals, episodes of a session's slow signal (ch, s, value).

    A second's slow-wave score is the slope of the spectrum of the channel whose slopes are most bimodal, its theta score the peak
    of the residual spectrum on the channel where that is most bimodal, its EMG the mean correlation of emg_channels. All three are cut at the valley between
    their two modes; runs shorter than the smoothing are rewritten as the state before.
    """
    settings = settings or StateSettings()
    freqs = freqs or [float(f) for f in range(1, 21)]
    span = int(window * rate)

    def scores() -> DataFrame:
        spectra = sg.spectrogram(samples, ["ch"], s, value, span, rate, freqs)
        line, flat = sg.spectrum_slope(spectra, ["ch", "window"], "freq", "magnitude")
        theta = ss.theta_score(flat, ["ch", "window"], "freq", "residual")
        slow = line.select("ch", "window", (-F.col("slope")).alias("x"))
        best = lambda df: df.join(ss.best_channel(ss.bimodality(df, ["ch"], "x"), "ch", "dip").select("ch"), "ch").select("window", "x")
        emg = sg.emg(samples, s, value, rate, span, emg_channels).select("window", F.col("correlation").alias("emg"))
        wide = best(slow).withColumnRenamed("x", "slow_wave").join(best(theta.select("ch", "window", F.col("peak").alias("x"))).withColumnRenamed("x", "theta"), "window").join(emg, "window")
        return wide.withColumn("s", F.col("window") * window).drop("window")

    scored = session.step("state_scores", scores)

    def states() -> DataFrame:
        out = scored.withColumn("one", F.lit(0))
        for name in ("slow_wave", "emg", "theta"):
            cut = ss.valley_threshold(scored.select(F.lit(0).alias("one"), name), ["one"], name).select("one", F.col("threshold").alias(f"_{name}"))
            out = out.join(F.broadcast(cut), "one", "left")  # one row
        over = lambda n: F.when(F.col(n) > F.coalesce(F.col(f"_{n}"), F.lit(float("inf"))), 1.0).otherwise(0.0).alias(n)
        marked = out.select("s", over("slow_wave"), over("emg"), over("theta"))
        raw = ss.classify(marked, "slow_wave", "emg", "theta", settings.slow_wave, settings.emg, settings.theta).select("s", "state")
        code = raw.select("s", F.element_at(F.create_map(*[F.lit(x) for p in {"WAKE": 1, "NREM": 3, "REM": 5}.items() for x in p]), F.col("state")).alias("code"))
        least = max(1, settings.smoothing // window)
        return sq.event_duration_states(code, [], "s", "code", {5: least, 3: least, 1: least}, [(5, 1), (3, 1), (1, 3)])

    state = session.step("states", states)
    names = F.create_map(*[F.lit(x) for p in {1: "WAKE", 3: "NREM", 5: "REM"}.items() for x in p])
    spans = session.step("state_intervals", lambda: iv.runs(state.withColumn("state", F.element_at(names, F.col("code"))), [], "s", "state").select("state", "start", "stop"))
    found = ss.episodes(spans, [], settings.packet_s, settings.microarousal_s)
    return {"scores": scored, "states": state, "intervals": spans} | {k: session.step(k, lambda k=k: found[k]) for k in found}


def clusters_by_centre(features: DataFrame, centre: str, point_id: str, vector: str, k: int = 10, least: int = 1000, rounds: int = 20) -> DataFrame:
    """O-SRT-19: point_id, centre, cluster (dense numbers from 0 over all centres): at each spatial centre the graph of k nearest neighbours is clustered by modularity; with fewer than `least` points a centre is one cluster.

    Centres are few (a grid over the probe) and go one after the other; each is a distributed job of its own.
    """
    rows = features.select(F.col(point_id).cast("long").alias("id"), F.col(centre).alias("centre"), F.col(vector).alias("x"))
    sizes = {r.centre: r["n"] for r in rows.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a centre
    small = [c for c, n in sizes.items() if n < least]
    parts = [rows.filter(F.col("centre").isin(small)).select("id", "centre", F.lit(0).cast("long").alias("_c"))] if small else []
    for c in sorted(set(sizes) - set(small)):
        own = rows.filter(F.col("centre") == c)
        near = jn.knn(own, own.withColumnRenamed("id", "other"), "id", "other", "x", k + 1).filter("id != other")
        both = near.select(F.col("id").alias("src"), F.col("other").alias("dst")).union(near.select("other", "id")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
        labels = so.modularity_clusters(both, rounds)
        parts.append(own.select("id", "centre").join(labels.select(F.col("node").alias("id"), F.col("cluster").alias("_c")), "id", "left").withColumn("_c", F.coalesce("_c", "id")))
    out = parts[0] if parts else rows.select("id", "centre", F.lit(0).cast("long").alias("_c")).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    number = out.groupBy(F.lit(0).alias("_all")).agg(F.array_sort(F.collect_set(F.struct("centre", "_c"))).alias("_l")).select(F.posexplode("_l").alias("cluster", "_g")).select("_g.*", "cluster")  # one row a cluster
    return out.join(number, ["centre", "_c"]).select(F.col("id").alias(point_id), F.col("centre").alias(centre), "cluster")


def sort_spikes(session: Session, samples: DataFrame, s: str, value: str, contacts: DataFrame, threshold: float, size: int, axes: int = 6, centres: DataFrame | None = None, reach_s: int = 15, reach_um: float = 150.0, k: int = 10, least: int = 1000) -> dict[str, DataFrame]:
    """O-SRT-20: spikes (spike, ch, s, unit) and labels of filtered samples: isolated peaks, their snippets on the peak's channel in principal
    coordinates, clusters at each centre, and whether a unit's autocorrelogram has a refractory dip.
    """
    from ..operators import waveforms as wv

    def detect() -> DataFrame:
        peaks = so.isolated_peaks(samples.withColumn(value, -F.col(value)), contacts, s, value, threshold, reach_s, reach_um)
        return peaks.select("ch", s).withColumn("spike", F.xxhash64("ch", s))

    spikes = session.step("detections", detect)

    def features() -> DataFrame:
        at = spikes.select("spike", "ch", F.explode(F.sequence(F.lit(-(size // 2)), F.lit(size - size // 2 - 1))).alias("lag"), F.col(s).alias("_s"))
        cut = at.withColumn(s, F.col("_s") + F.col("lag")).join(samples.select("ch", s, F.col(value).cast("double").alias("_v")), ["ch", s], "left")
        return cut.groupBy("spike", "ch").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", F.coalesce("_v", F.lit(0.0)).alias("v")))), lambda x: x.v).alias("wave"))

    waves = session.step("snippets", features)

    def cluster() -> DataFrame:
        pcs = wv.projected(waves, "wave", wv.principal_axes(waves, "wave", size, min(axes, size)))
        placed = pcs.join(contacts.select("ch", "x", "y"), "ch")
        at = centres if centres is not None else contacts.select(F.col("ch").alias("centre"), F.col("x").alias("cx"), F.col("y").alias("cy"))
        near = jn.nearest_centre(placed, at, "x", "y")
        return clusters_by_centre(near, "centre", "spike", "pc", k, least)

    units = session.step("clusters", cluster)
    found = session.step("spikes", lambda: spikes.join(units.select("spike", F.col("cluster").alias("unit")), "spike"))
    labels = session.step("labels", lambda: un.refractory_units(found.select("unit", s), s, 30, 500, (250, 500), (10, 50), 10).select("unit", F.when(F.col("refractory"), "good").otherwise("mua").alias("label")))
    return {"spikes": found, "snippets": waves, "labels": labels}


def postprocess(session: Session, spikes: DataFrame, metrics: DataFrame, labels: DataFrame, s: str, dead: int, rules: NoiseRules | None = None, partitions: str | None = None) -> dict[str, DataFrame]:
    """run of O-CL-01/08, O-SNK-10, O-SUP-21: spikes without doubles nearer than `dead` samples, labels after the noise rules, and a summary row. With `partitions` (a column of spikes) doubles are looked for in each by itself."""
    rules = rules or NoiseRules()
    keys = ["unit"] if partitions is None else [partitions, "unit"]
    thinned = session.step("post_spikes", lambda: sq.greedy_thin(spikes, keys, s, dead))
    named = labels.join(metrics, "unit", "left")
    final = session.step("post_labels", lambda: un.noise_rules(named.withColumn("label", F.when(F.col("label") == "noise", "unsorted").otherwise(F.col("label"))), rules.rules(), rules.together()).select("unit", "label"))
    summary = session.step("post_summary", lambda: rs.output_summary(spikes, thinned, final))
    return {"spikes": thinned, "labels": final, "summary": summary}


def export_events(session: Session, digital: DataFrame | None, analog: DataFrame | None, t: str, lag, width=None) -> DataFrame:
    """run of O-EVT-01/05/06: pulses of digital words (t, word) and analog channels (ch, t, value) in one table."""
    bits = lambda df: ev.digital_pulses(df, [], t, "word", width=width).filter("stop IS NOT NULL").select(F.col("bit").alias("ch"), F.col("start").alias("on"), F.col("stop").alias("off"))
    levels = lambda df: ev.analog_pulses(df, ["ch"], t, "value", width=width).select("ch", F.col("start").alias("on"), F.col("stop").alias("off"))
    return session.step("pulses", lambda: rs.pulse_table(digital, analog, bits, levels))
