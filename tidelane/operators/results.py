"""Lookups over sorter results and session tables, and the small steps of staging, labelling and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import range_join
from .units import merge_groups


def local_or_global_events(local: DataFrame, shared: DataFrame, spans: DataFrame, key: str, t: str, width) -> DataFrame:
    """O-SRC-20: key, t, from_shared: a folder's own events, or without any the shared ones inside its interval (spans: key, start, stop; ends closed)."""
    own = local.select(key, t)
    missing = spans.join(own.select(key).distinct(), key, "left_anti")
    hits = range_join(shared.select(t), missing, [], t, "start", "stop", width)
    return own.withColumn("from_shared", F.lit(False)).unionByName(hits.select(key, t, F.lit(True).alias("from_shared")))


def without_channels(contacts: DataFrame, bad: DataFrame) -> DataFrame:
    """O-UNI-16: contacts without the listed channels; a listed channel that isn't there is an error."""
    known = bad.select("ch").distinct()
    marked = known.join(contacts.select("ch").distinct().withColumn("_there", F.lit(True)), "ch", "left")
    checked = marked.select(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no such channel: "), F.col("ch").cast("string"))).cast(contacts.schema["ch"].dataType)).otherwise(F.col("ch")).alias("ch"))
    return contacts.join(checked, "ch", "left_anti")


def one_shank(contacts: DataFrame, shank: str, number) -> DataFrame:
    """O-UNI-16: the contacts of one shank."""
    return contacts.filter(F.col(shank) == number)


def attach_contacts(channels: DataFrame, contacts: DataFrame) -> DataFrame:
    """O-SIG-03: channels (ch) with x, y, shank, probe of the contact on them and two artifact groups, `group_probe` and `group_shank` (dense numbers
    from 0 of the probe, and of probe and shank). Contacts of other channels or of probes not above 0 are dropped; channels without a contact have nulls.
    """
    own = contacts.filter("probe > 0").join(channels.select("ch"), "ch", "left_semi").select("ch", "x", "y", "shank", "probe")
    number = lambda cols, name: own.groupBy(*cols).agg(F.min("ch").alias("_c")).withColumn("_all", F.lit(0)).groupBy("_all").agg(F.array_sort(F.collect_set(F.struct(*cols))).alias("_l")).select(F.posexplode("_l").alias(name, "_g")).select("_g.*", name)  # noqa: E731  # a probe's groups: bounded
    own = own.join(number(["probe"], "group_probe"), "probe").join(number(["probe", "shank"], "group_shank"), ["probe", "shank"])
    return channels.join(own, "ch", "left")


def nearest_channels(centres: DataFrame, contacts: DataFrame, k: int) -> DataFrame:
    """O-SUP-04: centre, channels: the k nearest contacts of each centre (x, y) in order, ties by the least channel. Both are bounded tables of a probe."""
    b = contacts.select("ch", F.col("x").alias("_x"), F.col("y").alias("_y"))
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    gap = F.struct((dx * dx + dy * dy).alias("d"), "ch")
    return centres.crossJoin(b).groupBy("centre").agg(F.transform(F.slice(F.array_sort(F.collect_list(gap)), 1, k), lambda s: s.ch).alias("channels"))


def sparse_channels(waves: DataFrame, contacts: DataFrame, how: str, limit, ties: str = "ch") -> DataFrame:
    """O-SUP-20: unit, ch: the channels that a unit is described on. waves: unit, ch, ptp. radius: contacts within `limit` of the unit's best channel;
    best_channels: the `limit` channels with the greatest ptp; closest_channels: the `limit` contacts nearest to its best channel. Of channels with equal ptp the one with the least `ties` (a column of waves) goes first.
    """
    by = F.struct((-F.col("ptp")).alias("p"), F.col(ties).alias("t"), "ch")
    best = waves.groupBy("unit").agg(F.min_by("ch", by).alias("_best"))
    if how == "best_channels":
        ranked = waves.groupBy("unit").agg(F.slice(F.array_sort(F.collect_list(by)), 1, limit).alias("_c"))
        return ranked.select("unit", F.explode(F.transform("_c", lambda s: s.ch)).alias("ch"))
    at = best.join(contacts.select(F.col("ch").alias("_best"), "x", "y"), "_best")
    if how == "closest_channels":
        near = nearest_channels(at.select(F.col("unit").alias("centre"), "x", "y"), contacts, limit)
        return near.select(F.col("centre").alias("unit"), F.explode("channels").alias("ch"))
    if how != "radius":
        raise ValueError("how must be radius, best_channels or closest_channels")
    b = contacts.select("ch", F.col("x").alias("_x"), F.col("y").alias("_y"))
    return at.crossJoin(b).filter(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) <= limit).select("unit", "ch")


def cluster_spikes(spikes: DataFrame, unit: str, wanted, t: str, spike_id: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """O-SUP-10: the spikes of one unit, or n of them: those with the least hash of id and seed."""
    own = spikes.filter(F.col(unit) == wanted)
    return own if n is None else own.orderBy(F.xxhash64(F.col(spike_id), F.lit(seed)), spike_id).limit(n)


def scaled_templates(spikes: DataFrame, templates: DataFrame, unit: str, spike_id: str, amplitude: str, wave: str) -> DataFrame:
    """O-SUP-10: spike_id, wave: the unit's template times the spike's amplitude."""
    return spikes.join(templates.select(unit, F.col(wave).cast("array<double>").alias("_w")), unit).select(spike_id, F.transform("_w", lambda x: x * F.col(amplitude)).alias(wave))


def total_samples(files: DataFrame, n_channels: int, itemsize: int = 2) -> DataFrame:
    """O-SUP-11: files, samples, whole: of files (path, length), how many frames they hold together, and whether each holds whole frames."""
    frame = n_channels * itemsize
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(F.floor(F.col("length") / frame)).alias("samples"), F.every(F.col("length") % frame == 0).alias("whole"))


def session_epochs(epochs: DataFrame, name: str) -> DataFrame:
    """O-SUP-12: name, start, stop of the merge points' epochs; without any one epoch of that name from 0 on, with no end."""
    own = epochs.select(F.col("name").cast("string").alias("name"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop")).filter("name IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL")
    none = own.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(F.lit(name).alias("name"), F.lit(0.0).alias("start"), F.lit(None).cast("double").alias("stop"))
    return own.unionByName(none)


def finite_only(events: DataFrame, t: str) -> DataFrame:
    """O-SUP-18: events whose time is a finite number."""
    x = F.col(t)
    return events.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def zero_frames(spark: SparkSession, n: int, n_channels: int, chunk: int = 1_000_000) -> DataFrame:
    """O-SUP-19: first, n, data: n frames of zeros (16-bit numbers) in rows of at most `chunk` frames."""
    rows = spark.range(-(-n // chunk)).select((F.col("id") * chunk).alias("first"))
    rows = rows.withColumn("n", F.least(F.lit(chunk).cast("long"), F.lit(n) - F.col("first")).cast("int"))
    return rows.withColumn("data", F.unhex(F.repeat(F.lit("00"), F.col("n") * 2 * n_channels)))


def relabelled(labels: DataFrame, metrics: DataFrame, noisy: Column) -> DataFrame:
    """O-SUP-21: unit, label from stored metrics alone: noise where the condition over them holds, 'unsorted' for former noise, other labels as they are."""
    rows = labels.join(metrics, "unit", "left")
    return rows.select("unit", F.when(F.coalesce(noisy, F.lit(False)), "noise").when(F.col("label") == "noise", "unsorted").otherwise(F.coalesce("label", F.lit("unsorted"))).alias("label"))


def output_summary(before: DataFrame, after: DataFrame, labels: DataFrame) -> DataFrame:
    """O-SUP-21: one row: units and spikes of stored outputs before and after, and how many units are noise. Spikes: unit."""
    count = lambda df, name: df.agg(F.count_distinct("unit").alias(f"n_units_{name}"), F.count(F.lit(1)).alias(f"n_spikes_{name}"))
    noise = labels.agg(F.count_if(F.col("label") == "noise").alias("n_noise"))
    return count(before, "initial").crossJoin(count(after, "final")).crossJoin(noise)  # one row each


def multi_day_names(sessions: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """O-SUP-22: keys, name of a staged group of sessions: multiday_<first>, or multiday_<first>_to_<last>; other characters than letters, digits, ., _ and - become _."""
    from ..functions.text import safe_name

    out = sessions.groupBy(*keys).agg(F.min_by(name, order).alias("_a"), F.max_by(name, order).alias("_b"), F.count(F.lit(1)).alias("_n"))
    text = F.concat(F.lit("multiday_"), safe_name(F.col("_a")), F.when(F.col("_n") > 1, F.concat(F.lit("_to_"), safe_name(F.col("_b")))).otherwise(""))
    return out.select(*keys, text.alias("name"))


def common_parent(paths: DataFrame, keys: list[str], path: str) -> DataFrame:
    """O-SUP-22: keys, parent: the deepest folder above all paths, or above the least path if they share none."""
    parts = paths.select(*keys, F.col(path).alias("_p"), F.split(path, "/").alias("_s"))
    ends = parts.groupBy(*keys).agg(F.min_by("_s", "_p").alias("_a"), F.max_by("_s", "_p").alias("_b"), F.count_distinct("_p").alias("_n"))  # what the least and greatest text share, all share
    same = F.zip_with("_a", "_b", lambda a, b: a.eqNullSafe(b))
    shared = F.slice("_a", 1, F.coalesce(F.array_position(same, False).cast("int"), F.size("_a") + 1) - 1)
    above = F.array_join(F.slice("_a", 1, F.size("_a") - 1), "/")
    return ends.select(*keys, F.when((F.col("_n") > 1) & (F.size(shared) > 1), F.array_join(shared, "/")).otherwise(above).alias("parent"))


def source_info(found: DataFrame, n_channels: int, rate: float) -> DataFrame:
    """O-SUP-22: path, source, n_channels, rate of discovered recordings (path, stream_channels, stream_rate): a stream descriptor's own numbers, else the session's."""
    described = F.col("stream_channels").isNotNull() & F.col("stream_rate").isNotNull()
    return found.select("path", F.when(described, "stream").otherwise("raw").alias("source"), F.when(described, F.col("stream_channels")).otherwise(F.lit(n_channels)).cast("int").alias("n_channels"), F.when(described, F.col("stream_rate")).otherwise(F.lit(rate)).cast("double").alias("rate"))


def check_sources(sources: DataFrame, keys: list[str]) -> DataFrame:
    """O-UNI-05: sources, if those of each group agree in channels and rate; else an error that names the group."""
    found = sources.groupBy(*keys).agg(F.count_distinct("n_channels", "rate").alias("_k"))
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    ok = found.select(*keys, F.when(F.col("_k") > 1, F.raise_error(F.concat(F.lit("recordings differ in channels or rate: "), name)).cast("boolean")).otherwise(True).alias("_ok"))
    return sources.join(ok.filter("_ok"), keys).drop("_ok")


def membership(units: DataFrame, unit: str, labels: str) -> DataFrame:
    """O-SUP-25: label, units: which units carry each label, from an array of labels a unit."""
    return units.select(F.col(unit), F.explode(labels).alias("label")).groupBy("label").agg(F.array_sort(F.collect_set(unit)).alias("units"))


def check_metrics(metrics: DataFrame, expected: dict[str, str]) -> DataFrame:
    """O-SUP-25: metrics, if every expected column is there with its type (numbers of any width count alike); else an error that names the first."""
    kind = lambda t: "number" if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else t
    have = dict(metrics.dtypes)
    for name, want in expected.items():
        if name not in have or kind(have[name]) != kind(want):
            raise TypeError(f"column {name} should be {want}, is {have.get(name, 'missing')}")
    return metrics


def columns_of(metrics: DataFrame, kind: str) -> list[str]:
    """O-SUP-26: names of the columns of a kind: number, text, flag, list, struct."""
    simple = {"string": "text", "boolean": "flag"}
    of = lambda t: simple.get(t) or ("list" if t.startswith("array") else "struct" if t.startswith(("struct", "map")) else "number")
    return [c for c, t in metrics.dtypes if of(t) == kind]


def metrics_table(metrics: DataFrame, unit: str, names: list[str]) -> DataFrame:
    """O-SUP-26: unit and the named metrics in that order, numbers rounded to 6 digits; names that aren't there are left out."""
    numbers = set(columns_of(metrics, "number"))
    return metrics.select(unit, *[F.round(F.col(c).cast("double"), 6).alias(c) if c in numbers else F.col(c) for c in names if c in metrics.columns and c != unit])


def tagged_channels(tags: DataFrame, groups: DataFrame, wanted: str) -> DataFrame:
    """O-SUP-27: ch: channels that carry the tag (tags: tag, channels, groups; either array may be null) or lie in a group that does (groups: group, ch)."""
    own = tags.filter(F.col("tag") == wanted)
    by_group = own.select(F.explode("groups").alias("group")).join(groups.select("group", "ch"), "group").select("ch")
    return own.select(F.explode("channels").alias("ch")).union(by_group).distinct()


def all_merges(candidates: DataFrame, units: DataFrame, score: str, least: float) -> DataFrame:
    """O-SUP-29: unit, merged: each unit with the least unit that chains of candidates (unit, other) of at least that score reach; itself without any."""
    groups = merge_groups(candidates.filter(F.col(score) >= least).select("unit", "other"))
    return units.select("unit").distinct().join(groups.select(F.col("node").alias("unit"), F.col("group").alias("_g")), "unit", "left").select("unit", F.coalesce("_g", "unit").alias("merged"))


def split_spikes(spikes: DataFrame, removed: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """O-SUP-30: (spikes that stay, a side table of those where the condition holds, with the reason). An unknown condition keeps the spike."""
    gone = F.coalesce(removed, F.lit(False))
    return spikes.filter(~gone), spikes.filter(gone).withColumn("reason", F.lit(reason))


def containers(files: DataFrame, base: str, suffixes: dict[str, str]) -> DataFrame:
    """O-SUP-31: kind, name, path of a session's containers: files <base>.<name>.<suffix>, by what their suffix says."""
    file = F.element_at(F.split("path", "/"), -1)
    kind = F.coalesce(*[F.when(F.endswith(file, F.lit(f".{s}")), k) for s, k in suffixes.items()])
    tail = F.substring(file, len(base) + 2, F.length(file))
    name = F.coalesce(*[F.when(F.endswith(file, F.lit(f".{s}")), F.expr(f"left(_t, greatest(length(_t) - {len(s) + 1}, 0))")) for s in suffixes])
    return files.withColumn("_t", tail).select(kind.alias("kind"), name.alias("name"), "path", F.startswith(file, F.lit(f"{base}.")).alias("_own")).filter("_own AND kind IS NOT NULL").drop("_own")


def unit_depth(waves: DataFrame, contacts: DataFrame) -> DataFrame:
    """O-SRT-22: unit, depth: the mean depth of the contacts weighted by the energy of the unit's mean waveform (waves: unit, ch, mean)."""
    power = waves.groupBy("unit", "ch").agg(F.sum(F.col("mean") * F.col("mean")).alias("_p")).join(contacts.select("ch", "y"), "ch")
    return power.groupBy("unit").agg((F.sum(F.col("_p") * F.col("y")) / F.when(F.sum("_p") > 0, F.sum("_p"))).alias("depth"))


def factored_templates(left: DataFrame, right: DataFrame) -> DataFrame:
    """O-SNK-07: unit, lag, ch, value: templates as sums over ranks of a time factor (left: unit, rank, lag, w) times a space factor (right: unit, rank, ch, u)."""
    return left.join(right, ["unit", "rank"]).groupBy("unit", "lag", "ch").agg(F.sum(F.col("w") * F.col("u")).alias("value"))


def export_tables(spikes: DataFrame, features: DataFrame, contacts: DataFrame, labels: DataFrame, templates: DataFrame, dead: int) -> dict[str, DataFrame]:
    """O-SNK-08: the tables of a manual-curation export, by name.

    spikes: spike (id), unit, s; features: spike, ch, w (the length of its features there). Of a unit's spikes less than `dead` samples
    after one that stays, none stays. A spike's amplitude is the length of all its features, its position the mean of the contacts weighted by w**2.
    """
    from .sequences import greedy_thin

    kept = greedy_thin(spikes, ["unit"], "s", dead).join(spikes.groupBy("unit", "s").agg(F.min("spike").alias("spike")), ["unit", "s"])
    own = features.join(kept.select("spike"), "spike", "left_semi").join(contacts.select("ch", "x", "y"), "ch")
    w = F.col("w") * F.col("w")
    placed = own.groupBy("spike").agg(F.sqrt(F.sum(w)).alias("amplitude"), *[(F.sum(w * F.col(c)) / F.when(F.sum(w) > 0, F.sum(w))).alias(c) for c in ("x", "y")])
    return {
        "spikes": kept.join(placed, "spike", "left"),
        "templates": templates,
        "channels": contacts,
        "labels": kept.select("unit").distinct().join(labels, "unit", "left").withColumn("label", F.coalesce("label", F.lit("mua"))),
    }


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """O-SNK-04/08/12: every table as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """O-SRC-25, O-SNK-04/08/12: what write_tables() wrote."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def event_table(peaks: DataFrame, t: str, before: float, after: float) -> DataFrame:
    """O-SNK-04: start, stop, peak, duration of events around peaks, none before 0."""
    start = F.greatest(F.col(t) - before, F.lit(0.0))
    return peaks.select(start.alias("start"), (F.col(t) + after).alias("stop"), F.col(t).alias("peak")).withColumn("duration", F.col("stop") - F.col("start"))


def empty_events(spark: SparkSession) -> DataFrame:
    """O-EVT-12: an event table without rows, to be filled by hand."""
    return spark.createDataFrame([], "start double, stop double, peak double, duration double")


def pulse_table(digital: DataFrame | None, analog: DataFrame | None, detect_digital, detect_analog) -> DataFrame:
    """O-EVT-06: source, ch, on, off of both kinds of pulses; a source that isn't there adds none. The detectors turn samples into ch, on, off."""
    parts = [f(df).select(F.lit(name).alias("source"), F.col("ch").cast("string").alias("ch"), "on", "off") for name, df, f in (("digital", digital, detect_digital), ("analog", analog, detect_analog)) if df is not None]
    if not parts:
        raise ValueError("neither digital nor analog samples were given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
