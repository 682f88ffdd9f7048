"""Queries of the unit analytics."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import units as un
from ..session import table
from .registry import DAY, HOUR, query, spikes
from .stat_queries import R6

BIN, BINS = HOUR // 2, 12
WINDOW = BIN * BINS + BIN / 2

#: Correlograms of all pairs of units that come within the window of each other.
CCG = f"""pr AS (SELECT a.unit, b.unit AS other, CAST(round_even((b.t - a.t) / {BIN}.0, 0) AS BIGINT) AS bin FROM spikes a JOIN spikes b ON b.t - a.t >= -{WINDOW} AND b.t - a.t < {WINDOW}),
 cn AS (SELECT unit, other, bin, count(*) AS n FROM pr WHERE abs(bin) <= {BINS} GROUP BY 1, 2, 3), gd AS (SELECT unit, other, unnest(range(-{BINS}, {BINS + 1})) AS bin FROM (SELECT DISTINCT unit, other FROM cn)),
 ccg AS (SELECT unit, other, bin, coalesce(n, 0) AS n FROM gd LEFT JOIN cn USING (unit, other, bin))"""
ERF = "(sign({x}) * (1 - ((1 / (1 + 0.3275911 * abs({x}))) * (0.254829592 + (1 / (1 + 0.3275911 * abs({x}))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs({x}))) * (1.421413741 + (1 / (1 + 0.3275911 * abs({x}))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs({x}))) * 1.061405429))))) * exp(-({x}) * ({x}))))"
FAR, NEAR, CENTRES = (6, 12), (3, 6), 3
_I = range(1, CENTRES + 1)
METRICS = f""", me AS (SELECT unit, other, greatest(sum(n) FILTER (bin BETWEEN 6 AND 11 OR bin BETWEEN -11 AND -7) / 11, sum(n) FILTER (bin BETWEEN 3 AND 5) / 3, sum(n) FILTER (bin BETWEEN -6 AND -4) / 3) AS s,
 {", ".join(f"sum(n) FILTER (abs(bin) BETWEEN 1 AND {i}) AS c{i}" for i in _I)} FROM ccg GROUP BY 1, 2),
 mx AS (SELECT unit, other, s, least({", ".join(f"c{i} / {2 * i}" for i in _I)}) AS c, {", ".join(f"(c{i} / 2 - s * {i}) / sqrt(1e-10 + 2 * s * {i}) AS x{i}" for i in _I)} FROM me),
 met AS (SELECT unit, other, CASE WHEN s > 0 THEN c / s END AS r, least({", ".join(f"0.5 * (1 + {ERF.replace('{x}', f'x{i}')})" for i in _I)}) AS q FROM mx)"""


def trains(spark, sf):
    return spikes(spark, sf).select("unit", "t")


def ccg(spark, sf):
    s = trains(spark, sf)
    return un.correlogram(s, s, "t", BIN, BINS)


def meetings(spark, sf):
    """The same without rows."""
    return un.Meetings(trains(spark, sf), "t", BIN, BINS)


@query("WITH {spikes}, " + CCG + " SELECT unit, other, bin, n FROM ccg")
def o_ccg_01_correlogram(spark, sf):
    return ccg(spark, sf)


@query("WITH {spikes}, " + CCG + METRICS + " SELECT unit, other, round(r, 6) AS r, round(q, 5) AS q FROM met")
def o_ccg_02_metrics(spark, sf):
    return un.meeting_metrics(meetings(spark, sf), FAR, NEAR, CENTRES, 6, 5)


@query("WITH {spikes}, " + CCG + METRICS + " SELECT unit, other, coalesce(r < 0.25 AND q < 0.05, false) AS refractory FROM met")
def o_ccg_03_refractory(spark, sf):
    return un.meeting_refractory(meetings(spark, sf), FAR, NEAR, CENTRES, (0.25, 0.05), (0.25, 0.05)).select("unit", "other", "refractory")


@query("WITH {spikes}, " + CCG + METRICS + """, z AS (SELECT unit, count(*) AS n, max(t) > min(t) AS long FROM spikes GROUP BY 1)
 SELECT unit, round(CASE WHEN n > 10 AND long THEN r END, 6) AS r, n > 10 AND long AND coalesce(r < 0.2 AND q < 0.2, false) AS refractory FROM z LEFT JOIN (SELECT * FROM met WHERE unit = other) USING (unit)""")
def o_ccg_03_refractory_units(spark, sf):
    return un.refractory_units(trains(spark, sf), "t", BIN, BINS, FAR, NEAR, CENTRES).withColumn("r", R6("r"))


@query("WITH {spikes}, " + CCG + METRICS + " SELECT unit, other, round(r, 6) AS r, CASE WHEN unit = other THEN coalesce(r < 0.2 AND q < 0.2, false) ELSE coalesce(r < 0.25 AND q < 0.05, false) END AS refractory FROM met")
def o_ccg_04_pair_matrix(spark, sf):
    return un.meeting_refractory(meetings(spark, sf), FAR, NEAR, CENTRES, (0.2, 0.2), (0.25, 0.05), 6)


@query("WITH {spikes}, " + CCG + """, sd AS (SELECT unit, other, abs(bin) AS lag, sum(n) / 2 AS n FROM ccg WHERE abs(bin) BETWEEN 2 AND 12 GROUP BY 1, 2, 3), sh AS (SELECT a.unit, a.other, a.lag, sum(b.n) / 3 AS n FROM sd a JOIN sd b ON a.unit = b.unit AND a.other = b.other AND abs(a.lag - b.lag) <= 1 GROUP BY 1, 2, 3)
 SELECT *, coalesce(r_unit >= 0.3 AND r_other >= 0.3, false) AS alike FROM (SELECT p.unit, p.other, round(CASE WHEN stddev_pop(p.n) > 1e-12 AND stddev_pop(u.n) > 1e-12 THEN corr(p.n, u.n) END, 6) AS r_unit, round(CASE WHEN stddev_pop(p.n) > 1e-12 AND stddev_pop(o.n) > 1e-12 THEN corr(p.n, o.n) END, 6) AS r_other
 FROM sh p LEFT JOIN sh u ON u.unit = p.unit AND u.other = p.unit AND u.lag = p.lag LEFT JOIN sh o ON o.unit = p.other AND o.other = p.other AND o.lag = p.lag WHERE p.unit < p.other GROUP BY 1, 2)""")
def o_srt_24_shape_gate(spark, sf):
    return un.meeting_shape_gate(meetings(spark, sf), 2, 12, 0.3, 6)


@query("WITH {spikes}, " + CCG + ", rn AS (SELECT unit, count(*) AS total FROM spikes GROUP BY 1) SELECT unit, other, bin, round(n / total / 0.5, 6) AS rate FROM ccg JOIN rn USING (unit)")
def o_ccg_05_rate_correlogram(spark, sf):
    return un.long_rows(un.meeting_rates(meetings(spark, sf), 0.5, 6), ["unit", "other"], -BINS, {"rate": "rate"})


@query("WITH {spikes}, " + CCG + """, a AS (SELECT unit, avg(n) FILTER (abs(bin) BETWEEN 1 AND 2) AS i, avg(n) FILTER (abs(bin) BETWEEN 8 AND 12) AS o, avg(n) FILTER (abs(bin) BETWEEN 3 AND 4) AS tr, avg(n) FILTER (abs(bin) BETWEEN 5 AND 7) AS pk FROM ccg WHERE unit = other GROUP BY unit)
 SELECT unit, round(CASE WHEN o > 0 THEN i / o END, 6) AS burst, round(CASE WHEN pk + tr > 0 THEN (pk - tr) / (pk + tr) END, 6) AS modulation FROM a""")
def o_ccg_06_acg_metrics(spark, sf):
    return un.acg_metrics(ccg(spark, sf).filter("unit = other"), ["unit"], (1, 2), (8, 12), (3, 4), (5, 7)).select("unit", R6("burst").alias("burst"), R6("modulation").alias("modulation"))


@query("""WITH {spikes}, i AS (SELECT unit, t - lag(t) OVER (PARTITION BY unit ORDER BY t) AS d FROM spikes), n AS (SELECT unit, count(*) AS total FROM spikes GROUP BY 1),
 b AS (SELECT unit, CAST(floor((log10(d / 3600000000.0) + 3) / 0.1) AS BIGINT) AS bin, count(*) AS n FROM i WHERE d > 0 GROUP BY 1, 2) SELECT unit, bin, round(n / total, 6) AS density FROM b JOIN n USING (unit) WHERE bin BETWEEN 0 AND 99""")
def o_ccg_08_log_isi(spark, sf):
    return un.log_isi(spikes(spark, sf), ["unit"], "t", HOUR * 1.0, -3.0, 0.1, 100, DAY).withColumn("density", R6("density"))


@query("WITH {spikes}, " + CCG + ", m AS (SELECT unit, bin, avg(n) AS m FROM ccg WHERE unit <> other GROUP BY 1, 2), c AS (SELECT unit, avg(m) FILTER (abs(bin) <= 2) AS a, avg(m) FILTER (abs(bin) > 8) AS b FROM m GROUP BY unit) SELECT unit, round(CASE WHEN b > 0 THEN a / b END, 6) AS modulation FROM c")
def o_ccg_09_population_modulation(spark, sf):
    known = trains(spark, sf).filter("unit IS NOT NULL")
    return un.meeting_modulation(un.Meetings(known, "t", BIN, BINS), 2, 8).withColumn("modulation", R6("modulation"))


def excess(spark, sf, what, **more):
    return un.meeting_excess(meetings(spark, sf), what, 3.0, 6, 0.05, **more)


KERNEL = ", ".join(repr(w) for w in un.hollow_gaussian(3.0, 6))


@query("WITH {spikes}, " + CCG + f", w AS (SELECT unnest(range(-6, 7)) AS d, unnest([{KERNEL}]) AS w) SELECT a.unit, a.other, a.bin, a.n, round(sum(b.n * w) / sum(w), 6) AS baseline FROM ccg a JOIN ccg b ON a.unit = b.unit AND a.other = b.other JOIN w ON b.bin - a.bin = d WHERE a.unit <> a.other GROUP BY 1, 2, 3, 4")
def o_ccg_11_baseline(spark, sf):
    return un.long_rows(excess(spark, sf, "baseline", digits=6), ["unit", "other"], -BINS, {"n": "n", "baseline": "baseline"})


BASELINE = f", w AS (SELECT unnest(range(-6, 7)) AS d, unnest([{KERNEL}]) AS w), bl AS (SELECT a.unit, a.other, a.bin, a.n, sum(b.n * w) / sum(w) AS baseline FROM ccg a JOIN ccg b ON a.unit = b.unit AND a.other = b.other JOIN w ON b.bin - a.bin = d WHERE a.unit <> a.other GROUP BY 1, 2, 3, 4), ex AS (SELECT *, n > baseline + {NormalDist().inv_cdf(1 - 0.05 / (2 * BINS + 1))!r} * sqrt(baseline) AS excess FROM bl)"


@query("WITH {spikes}, " + CCG + BASELINE + " SELECT DISTINCT unit AS pre, other AS post FROM ex WHERE excess AND bin BETWEEN 1 AND 3")
def o_ccg_10_connections(spark, sf):
    return excess(spark, sf, "hits", bins=(1, 3)).select(F.col("unit").alias("pre"), F.col("other").alias("post"))


@query("WITH {spikes}, " + CCG + BASELINE + ", z AS (SELECT unit, count(*) AS total FROM spikes GROUP BY 1) SELECT unit, other, round(sum(CASE WHEN excess THEN greatest(n - baseline, 0) ELSE 0 END) / any_value(total), 6) AS probability FROM ex JOIN z USING (unit) GROUP BY 1, 2")
def o_ccg_11_transmission(spark, sf):
    return excess(spark, sf, "probability", digits=6)


EDGES = "e AS (SELECT DISTINCT l_partkey % 50 AS pre, l_suppkey % 50 AS post FROM lineitem WHERE l_quantity > 48)"


def edges(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity > 48").select((F.col("l_partkey") % 50).alias("pre"), (F.col("l_suppkey") % 50).alias("post")).distinct()


@query("WITH " + EDGES + " SELECT unit, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT pre AS unit, 1 AS o, 0 AS i FROM e UNION ALL SELECT post, 0, 1 FROM e) GROUP BY unit")
def o_ccg_12_degrees(spark, sf):
    return un.degrees(edges(spark, sf))


PBIN = HOUR
PSTH = f"""ev AS (SELECT ch, t FROM spikes WHERE ch IN ('purchase', 'error')), sp AS (SELECT unit, t FROM spikes), ne AS (SELECT ch, count(*) AS e FROM ev GROUP BY 1),
 hit AS (SELECT ch, unit, CAST(floor((sp.t - ev.t) / {PBIN}.0) AS BIGINT) AS bin, count(*) AS n FROM ev JOIN sp ON sp.t - ev.t >= -{10 * PBIN} AND sp.t - ev.t < {10 * PBIN} GROUP BY 1, 2, 3),
 gr AS (SELECT ch, e, unit, unnest(range(-10, 10)) AS bin FROM ne, (SELECT DISTINCT unit FROM sp)), psth AS (SELECT ch, unit, bin, coalesce(n, 0) AS n, coalesce(n, 0) / e AS rate FROM gr LEFT JOIN hit USING (ch, unit, bin))"""


def psth(spark, sf):
    s = spikes(spark, sf)
    return un.psth(s.filter("ch IN ('purchase', 'error')").select("ch", "t"), s.select("unit", "t"), "t", PBIN, 10, HOUR * 1.0, ["ch"])


@query("WITH {spikes}, " + PSTH + " SELECT ch, unit, bin, n, round(rate, 6) AS rate FROM psth")
def o_ps_01_psth(spark, sf):
    return psth(spark, sf).select("ch", "unit", "bin", "n", R6("rate").alias("rate"))


@query("WITH {spikes}, " + PSTH + """, m AS (SELECT ch, unit, avg(rate) FILTER (bin >= 0) AS a, avg(rate) FILTER (bin < 0) AS b, arg_max(bin, (n, -bin)) AS peak_bin FROM psth GROUP BY 1, 2)
 SELECT ch, unit, round(CASE WHEN b > 0 THEN a / b END, 6) AS ratio, round(CASE WHEN a + b > 0 THEN (a - b) / (a + b) END, 6) AS index, peak_bin FROM m""")
def o_ps_01_modulation(spark, sf):
    return un.psth_modulation(psth(spark, sf), ["ch", "unit"]).select("ch", "unit", R6("ratio").alias("ratio"), R6("index").alias("index"), "peak_bin")


@query("WITH {spikes} SELECT unit, (t % 86400000000) // 3600000000 AS bin, round(count(*) / 30.0, 6) AS rate FROM spikes GROUP BY 1, 2")
def o_ps_02_folded_histogram(spark, sf):
    return un.folded_histogram(spikes(spark, sf), ["unit"], "t", DAY, HOUR, F.lit(30.0), HOUR * 1.0).withColumn("rate", R6("rate"))


@query("WITH {spikes}, " + PSTH + """, m AS (SELECT ch, unit, avg(rate) FILTER (bin >= 0) AS a, avg(rate) FILTER (bin < 0) AS b FROM psth GROUP BY 1, 2), i AS (SELECT ch, unit, (a - b) / nullif(a + b, 0) AS i FROM m)
 SELECT unit, round(max(i) FILTER (ch = 'error'), 6) AS error_modulation, round(max(i) FILTER (ch = 'purchase'), 6) AS purchase_modulation FROM i GROUP BY unit""")
def o_ps_03_event_metrics(spark, sf):
    m = un.psth_modulation(psth(spark, sf), ["ch", "unit"])
    wide = m.groupBy("unit").pivot("ch", ["error", "purchase"]).agg(R6(F.max("index")))
    return wide.select("unit", F.col("error").alias("error_modulation"), F.col("purchase").alias("purchase_modulation"))


@query("""WITH {spikes}, e AS (SELECT id AS event, t AS start, t + 21600000000 AS stop FROM spikes WHERE ch = 'purchase'), h AS (SELECT unit, event, count(*) AS n FROM spikes JOIN e ON t BETWEEN start AND stop GROUP BY 1, 2),
 o AS (SELECT unit, count(*) AS k, sum(n) AS n FROM h GROUP BY 1), tt AS (SELECT count(*) AS e, sum(stop - start) / 3600000000.0 AS s FROM e)
 SELECT unit, round(coalesce(k, 0) / e, 6) AS participation, round(coalesce(n, 0) / e, 6) AS spikes_per_event, round(coalesce(n, 0) / s, 6) AS rate_inside FROM (SELECT DISTINCT unit FROM spikes) LEFT JOIN o USING (unit), tt""")
def o_ps_05_participation(spark, sf):
    s = spikes(spark, sf)
    e = s.filter("ch = 'purchase'").select(F.col("id").alias("event"), F.col("t").alias("start"), (F.col("t") + 6 * HOUR).alias("stop"))
    return un.participation(s, e, "t", 6 * HOUR, HOUR * 1.0).select("unit", *[R6(c).alias(c) for c in ("participation", "spikes_per_event", "rate_inside")])


MAPS = """tr AS (SELECT unit AS animal, t, v AS x FROM spikes WHERE ch = 'view'), sp AS (SELECT unit AS animal, id % 4 AS unit, t FROM spikes WHERE ch <> 'view'),
 occ AS (SELECT animal, CAST(floor(x / 5.0) AS BIGINT) AS bin, count(*) AS occupancy FROM tr GROUP BY 1, 2), pl AS (SELECT animal, unit, (SELECT x FROM tr WHERE tr.animal = sp.animal ORDER BY abs(tr.t - sp.t), tr.t DESC LIMIT 1) AS x FROM sp),
 cnt AS (SELECT animal, unit, CAST(floor(x / 5.0) AS BIGINT) AS bin, count(*) AS n FROM pl WHERE x IS NOT NULL GROUP BY 1, 2, 3),
 maps AS (SELECT animal, unit, bin, coalesce(n, 0) AS n, occupancy, coalesce(n, 0) / occupancy * 10.0 AS rate FROM (SELECT DISTINCT animal, unit FROM cnt) JOIN occ USING (animal) LEFT JOIN cnt USING (animal, unit, bin))"""


def maps(spark, sf):
    s = spikes(spark, sf)
    track = s.filter("ch = 'view'").select(F.col("unit").alias("animal"), "t", F.col("v").alias("x"))
    sp = s.filter("ch != 'view'").select(F.col("unit").alias("animal"), (F.col("id") % 4).alias("unit"), "t")
    return un.rate_map(sp, track, ["animal"], "t", "x", 5.0, 10.0, DAY)


@query("WITH {spikes}, " + MAPS + " SELECT animal, unit, bin, n, occupancy, round(rate, 6) AS rate FROM maps")
def o_map_01_rate_map(spark, sf):
    return maps(spark, sf).select("animal", "unit", "bin", "n", "occupancy", R6("rate").alias("rate"))


@query("WITH {spikes}, " + MAPS + """, f AS (SELECT *, rate > 0.1 * max(rate) OVER (PARTITION BY animal, unit) AS up FROM maps), g AS (SELECT *, sum(fresh) OVER (PARTITION BY animal, unit ORDER BY bin) AS run FROM (SELECT *, CASE WHEN up = lag(up) OVER (PARTITION BY animal, unit ORDER BY bin) THEN 0 ELSE 1 END AS fresh FROM f)),
 r AS (SELECT animal, unit, run, min(bin) AS start, max(bin) AS stop, count(*) AS n FROM g WHERE up GROUP BY 1, 2, 3 HAVING count(*) >= 2)
 SELECT animal, unit, start, stop, round(peak, 6) AS peak FROM (SELECT r.animal, r.unit, start, stop, max(m.rate) AS peak FROM r JOIN maps m ON m.animal = r.animal AND m.unit = r.unit AND m.bin BETWEEN start AND stop GROUP BY 1, 2, 3, 4) WHERE peak > 8""")
def o_map_02_place_fields(spark, sf):
    return un.place_fields(maps(spark, sf).select("animal", "unit", "bin", "rate"), ["animal", "unit"], 0.1, 2, 8.0).withColumn("peak", R6("peak"))


@query("WITH {spikes}, " + MAPS + """, m AS (SELECT animal, unit, rate, lag(rate) OVER w AS a, lead(rate) OVER w AS b FROM maps WINDOW w AS (PARTITION BY animal, unit ORDER BY bin))
 SELECT animal, unit, CASE WHEN isfinite(c) THEN round(c, 5) END AS coherence FROM (SELECT animal, unit, corr(rate, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END) AS c FROM m GROUP BY 1, 2 HAVING count(*) > 3)""")
def o_map_02_coherence(spark, sf):
    m = maps(spark, sf)
    long = m.groupBy("animal", "unit").agg(F.count(F.lit(1)).alias("k")).filter("k > 3").drop("k")
    out = un.spatial_coherence(m.select("animal", "unit", "bin", "rate"), ["animal", "unit"]).join(long, ["animal", "unit"])
    return out.withColumn("coherence", F.when(~F.isnan("coherence"), F.round("coherence", 5)))


@query("WITH {spikes}, " + MAPS + """, c AS (SELECT animal, unit, rate, sum(rate) OVER (PARTITION BY animal, unit ORDER BY rate DESC, bin ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY animal, unit ORDER BY rate DESC, bin) AS r, sum(rate) OVER (PARTITION BY animal, unit) AS tot, count(*) OVER (PARTITION BY animal, unit) AS n FROM maps)
 SELECT animal, unit, round(max(rate), 6) AS peak, round(min(CASE WHEN c >= 0.75 * tot - 1e-9 THEN r END) / max(n), 6) AS coverage FROM c GROUP BY 1, 2""")
def o_map_03_coverage(spark, sf):
    return un.coverage(maps(spark, sf).select("animal", "unit", "bin", "rate"), ["animal", "unit"], 0.75 - 1e-12).select("animal", "unit", R6("peak").alias("peak"), R6("coverage").alias("coverage"))


@query("WITH {spikes}, " + MAPS + " SELECT a.animal, round(sum(abs(a.rate - b.rate)) / nullif(sum(a.rate + b.rate), 0), 6) AS degree FROM maps a JOIN maps b ON a.animal = b.animal AND a.bin = b.bin AND a.unit = 0 AND b.unit = 1 GROUP BY 1")
def o_map_04_splitter_degree(spark, sf):
    m = maps(spark, sf)
    return un.splitter_degree(m.filter("unit = 0"), m.filter("unit = 1"), ["animal"], "rate").withColumn("degree", R6("degree"))


@query(f"WITH {{spikes}}, p AS (SELECT id, v - 20 AS x, (id % 61) - 30.0 AS y FROM spikes) SELECT id, round(CASE WHEN abs(x) <= 10 AND abs(y) <= 20 THEN y + 20 ELSE 20 + 40 * ({math.pi / 2!r} - atan2(y, abs(x))) * (CASE WHEN x < 0 THEN -1 ELSE 1 END) END, 6) AS position FROM p")
def o_map_05_linearize(spark, sf):
    s = spikes(spark, sf).select("id", (F.col("v") - 20).alias("x"), (F.col("id") % 61 - 30.0).alias("y"))
    return s.select("id", R6(un.linearize_maze(F.col("x"), F.col("y"), 20.0, 40.0)).alias("position"))


@query("""WITH {spikes}, p AS (SELECT ch, CAST(floor(24 * ((t % 86400000000) / 86400000000.0)) AS BIGINT) AS bin FROM spikes), n AS (SELECT ch, bin, count(*) AS n FROM p GROUP BY 1, 2), k AS (SELECT ch FROM p GROUP BY ch HAVING count(*) > 50),
 g AS (SELECT ch, unnest(range(24)) AS bin FROM k), d AS (SELECT ch, bin, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (ch, bin)) SELECT a.ch, a.bin, a.n, (SELECT sum(b.n) / 5 FROM d b WHERE b.ch = a.ch AND (b.bin - a.bin + 26) % 24 <= 4) AS smoothed FROM d a""")
def o_map_06_phase_histogram(spark, sf):
    s = spikes(spark, sf).select("ch", ((F.pmod(F.col("t"), F.lit(DAY)) + 0.5) / DAY * (2 * math.pi)).alias("phase"))
    return un.phase_histogram(s, ["ch"], "phase", 24, 5, 50)


@query("WITH {spikes}, b AS (SELECT ch, t // 3600000000 AS bin, count(*) AS n FROM spikes GROUP BY 1, 2), w AS (SELECT unnest([-1, 0, 1]) AS d, unnest([0.25, 0.5, 0.25]) AS w) SELECT a.ch, a.bin, a.n, round(sum(b.n * w), 6) AS smooth FROM b a JOIN b ON a.ch = b.ch JOIN w ON a.bin - b.bin = d GROUP BY 1, 2, 3")
def o_map_07_convolve_counts(spark, sf):
    b = spikes(spark, sf).groupBy("ch", F.floor(F.col("t") / HOUR).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return un.convolve_counts(b, ["ch"], "n", [0.25, 0.5, 0.25]).select("ch", "bin", "n", R6("smooth").alias("smooth"))


UNITS = "u AS (SELECT unit, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, max(v) AS top, min(v) AS low FROM spikes GROUP BY unit)"


def units(spark, sf):
    return spikes(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.max("v").alias("top"), F.min("v").alias("low"))


@query("WITH {spikes}, " + UNITS + " SELECT unit, CASE WHEN coalesce(mean > 19 AND n > 60, false) OR coalesce(sd < 15, false) OR coalesce(abs(low) < 0.05, false) OR coalesce(top <= 60, false) THEN 'noise' ELSE 'good' END AS label FROM u")
def o_cl_01_noise_rules(spark, sf):
    rules = {"mean": (">", 19.0), "n": (">", 60.0), "sd": ("<", 15.0), "low": ("abs<", 0.05), "top": ("<=", 60.0)}
    return un.noise_rules(units(spark, sf).withColumn("label", F.lit("good")), rules, ("mean", "n")).select("unit", "label")


@query("WITH {spikes}, " + UNITS + ", d AS (SELECT unit, count(DISTINCT t // 86400000000) AS days FROM spikes GROUP BY 1) SELECT unit, n, round(n / 720.0, 6) AS firing_rate, round(days / 30.0, 6) AS presence_ratio, round(mean / sd, 6) AS snr, round((SELECT median(v) FROM spikes s WHERE s.unit = u.unit), 6) AS amplitude_median FROM u JOIN d USING (unit)")
def o_cl_02_quality_metrics(spark, sf):
    s = spikes(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.floor(F.col("t") / DAY)).alias("days"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.median("v").alias("med"))
    return s.select("unit", "n", R6(F.col("n") / 720.0).alias("firing_rate"), R6(F.col("days") / 30.0).alias("presence_ratio"), R6(F.col("mean") / F.col("sd")).alias("snr"), R6("med").alias("amplitude_median"))


@query("WITH {spikes}, " + UNITS + " SELECT unit, CASE WHEN low * 10 > 6 AND sd / 50 > 0.425 THEN 'Wide Interneuron' WHEN sd / 50 <= 0.425 THEN 'Narrow Interneuron' ELSE 'Pyramidal Cell' END AS cell_type FROM u")
def o_cl_03_cell_type(spark, sf):
    u = units(spark, sf).select("unit", (F.col("sd") / 50).alias("ttp"), (F.col("low") * 10).alias("tau"))
    return un.cell_type(u, "ttp", "tau").select("unit", "cell_type")


@query("""WITH {spikes}, g AS (SELECT unit, t, v, unnest([0.0, 5.0, 10.0, 20.0, 40.0]) AS cutoff FROM spikes), i AS (SELECT unit, cutoff, t - lag(t) OVER (PARTITION BY unit, cutoff ORDER BY t) AS d FROM g WHERE v >= cutoff),
 s AS (SELECT unit, cutoff, count(*) FILTER (d < 7200000000) / count(*) AS s FROM i GROUP BY 1, 2), x AS (SELECT unit, max(CASE WHEN s > 0.08 THEN cutoff END) AS d FROM s GROUP BY 1)
 SELECT unit, min(cutoff) FILTER (d IS NULL OR cutoff > d) AS cutoff FROM s JOIN x USING (unit) GROUP BY unit""")
def o_cl_04_cutoff(spark, sf):
    return un.lowest_clean_cutoff(spikes(spark, sf).select("unit", "t", "v"), ["unit"], "t", "v", [0, 5, 10, 20, 40], 2 * HOUR, 0.08)


SIMILAR = """tp AS (SELECT label AS unit, list_transform(range(1, 17), lambda i: i) AS ix FROM embeddings GROUP BY label), tm AS (SELECT label AS unit, i, avg(embedding[i]) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
 sim AS (SELECT a.unit, b.unit AS other, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS similarity FROM tm a JOIN tm b ON a.i = b.i AND a.unit < b.unit GROUP BY 1, 2)"""


def templates(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return e.groupBy(F.col("label").alias("unit")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("wave"))


@query("WITH {spikes}, t AS (SELECT unit, (t // 3600000000) % 24 AS h, count(*) AS n FROM spikes GROUP BY 1, 2), l AS (SELECT unit, sqrt(sum(n * n)) AS l FROM t GROUP BY 1) SELECT a.unit, b.unit AS other, round(sum(a.n * b.n) / any_value(x.l * y.l), 6) AS similarity FROM t a JOIN t b ON a.h = b.h AND a.unit < b.unit JOIN l x ON x.unit = a.unit JOIN l y ON y.unit = b.unit GROUP BY 1, 2")
def o_srt_18_similarity(spark, sf):
    counts = spikes(spark, sf).groupBy("unit", (F.floor(F.col("t") / HOUR) % 24).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    wave = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0)).cast("double"))
    t = counts.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m")).select("unit", wave.alias("wave"))
    return un.template_similarity(t, "unit", "wave", 0.0, 6)


@query("WITH " + SIMILAR + " SELECT unit, other, round(similarity, 4) AS similarity FROM sim")
def o_cl_06_template_similarity(spark, sf):
    return un.template_similarity(templates(spark, sf), "unit", "wave").withColumn("similarity", F.round("similarity", 4))


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 400 AS u, 1000 + l_suppkey % 300 AS v FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.05 AND l_tax = 0.05), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS node, u AS g FROM b UNION SELECT b.v, r.g FROM r JOIN b ON r.node = b.u) SELECT node, min(g) AS \"group\" FROM r GROUP BY node")
def o_cl_06_merge_groups(spark, sf):
    e = table(spark, sf, "lineitem").filter("l_quantity = 50 AND l_discount = 0.05 AND l_tax = 0.05").select((F.col("l_partkey") % 400).alias("unit"), (1000 + F.col("l_suppkey") % 300).alias("other"))
    return un.merge_groups(e)


@query("""WITH {spikes}, s AS (SELECT unit, t FROM spikes UNION ALL SELECT 10000 + unit, t + 1000 FROM spikes WHERE unit % 7 = 0 AND v > 8), n AS (SELECT unit, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.unit, b.unit AS other, count(DISTINCT a.t) AS c FROM s a JOIN s b ON b.t - a.t >= -2000 AND b.t - a.t < 2000 AND a.unit <> b.unit GROUP BY 1, 2)
 SELECT DISTINCT c.unit FROM c JOIN n ON n.unit = c.unit JOIN n m ON m.unit = c.other WHERE (n.n < m.n OR (n.n = m.n AND c.unit > other)) AND c / n.n >= 0.5""")
def o_cl_07_redundant_units(spark, sf):
    s = spikes(spark, sf).select("unit", "t", "v")
    return un.redundant_units(s.select("unit", "t").union(s.filter("unit % 7 = 0 AND v > 8").select(F.col("unit") + 10000, F.col("t") + 1000)), "t", 2000)
