"""Queries of the signal and state operators: hourly means of each event type are the samples of a channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals as sg
from ..operators import states as ss
from ..operators.intervals import runs
from .registry import HOUR, query, spikes
from .stat_queries import R6

#: Hours are counted from the first day's midnight on, up to the last event.
BASE = "(SELECT min(t) // 86400000000 * 24 FROM spikes)"
HOURS = f"""hr AS (SELECT h, c, avg(v) AS m FROM (SELECT t // 3600000000 - {BASE} AS h, ch AS c, v FROM spikes) GROUP BY 1, 2), gr AS (SELECT ch, unnest(range(n)) AS s FROM (SELECT DISTINCT ch FROM spikes), (SELECT max(h) + 1 AS n FROM hr)),
 sm AS (SELECT ch, s, coalesce(m, 0) AS v FROM gr LEFT JOIN hr ON c = ch AND h = s)"""


def with_hours(spark, sf):
    """spikes with `hour`, counted from the first day's midnight on."""
    s = spikes(spark, sf)
    first = s.agg((F.floor(F.min("t") / (24 * HOUR)) * 24).alias("_first"))
    return s.crossJoin(F.broadcast(first)).withColumn("hour", F.floor(F.col("t") / HOUR) - F.col("_first")).drop("_first")  # one row


def hourly(spark, sf):
    """ch, s (hour), v: dense; 0 where nothing happened."""
    s = with_hours(spark, sf)
    hours = s.groupBy("ch", F.col("hour").alias("s")).agg(F.avg("v").alias("v"))
    last = s.agg(F.max("hour").alias("_last"))
    grid = s.select("ch").distinct().crossJoin(F.broadcast(last)).select("ch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("s"))  # one row
    return grid.join(hours, ["ch", "s"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


PLACES = {"click": 0.0, "error": 20.0, "purchase": 40.0, "view": 60.0}


def contacts(spark, sf):
    y = F.create_map(*[c for k, v in PLACES.items() for c in (F.lit(k), F.lit(v))])
    return spikes(spark, sf).select("ch").distinct().withColumn("x", F.lit(0.0)).withColumn("y", F.coalesce(F.element_at(y, F.col("ch")), F.lit(80.0)))


@query("WITH {spikes}, " + HOURS + " SELECT ch, s, round(v - median(v) OVER (PARTITION BY s), 6) AS v FROM sm")
def o_sig_01_common_reference(spark, sf):
    return sg.common_reference(hourly(spark, sf), [], "s", "v").select("ch", "s", R6("v").alias("v"))


CONTACTS_SQL = "ct AS (SELECT DISTINCT ch, CASE ch WHEN 'click' THEN 0.0 WHEN 'error' THEN 20.0 WHEN 'purchase' THEN 40.0 WHEN 'view' THEN 60.0 ELSE 80.0 END AS y FROM spikes)"


@query("WITH {spikes}, " + HOURS + ", " + CONTACTS_SQL + " SELECT ch, s, round(v - coalesce((SELECT median(b.v) FROM sm b WHERE b.s = a.s AND b.ch IN (SELECT q.ch FROM ct p JOIN ct q ON p.ch = a.ch AND p.ch <> q.ch AND abs(p.y - q.y) BETWEEN 10 AND 30)), 0), 6) AS v FROM sm a")
def o_sig_01_local_reference(spark, sf):
    return sg.local_reference(hourly(spark, sf), contacts(spark, sf), "s", "v", 10.0, 30.0).select("ch", "s", R6("v").alias("v"))


TAPS = sg.sinc_kernel(0.02, 0.2, 1.0, 24)


@query("WITH {spikes}, " + HOURS + f", k AS (SELECT unnest(range(-24, 25)) AS d, unnest([{', '.join(repr(float(x)) for x in TAPS[::-1])}]) AS w) SELECT a.ch, a.s, round(sum(b.v * w), 6) AS v FROM sm a, k JOIN sm b ON b.ch = a.ch AND b.s = greatest(least(a.s + d, (SELECT max(s) FROM sm)), 0) GROUP BY 1, 2")
def o_sig_02_band_pass(spark, sf):
    return sg.filtered(hourly(spark, sf), ["ch"], "s", "v", 0.02, 0.2, 1.0, 24, 128).select("ch", "s", R6("v").alias("v"))


@query("WITH {spikes}, " + HOURS + " SELECT ch, s // 8 AS s, v FROM sm WHERE s % 8 = 0")
def o_sig_04_decimate(spark, sf):
    return sg.decimate(hourly(spark, sf), "s", 8)


def convolved(taps, name="fl"):
    """A common table expression: sm under a kernel, its ends extended by their last value."""
    reach = len(taps) // 2
    return f", {name}_k AS (SELECT unnest(range(-{reach}, {reach + 1})) AS d, unnest([{', '.join(repr(float(x)) for x in taps[::-1])}]) AS w), {name} AS (SELECT a.ch, a.s, sum(b.v * w) AS v FROM sm a, {name}_k JOIN sm b ON b.ch = a.ch AND b.s = greatest(least(a.s + d, (SELECT max(s) FROM sm)), 0) GROUP BY 1, 2)"


@query("WITH {spikes}, " + HOURS + convolved(sg.sinc_kernel(None, 0.1125, 1.0, 64)) + " SELECT ch, s // 4 AS s, round(v, 6) AS v FROM fl WHERE s % 4 = 0")
def o_sig_06_lfp(spark, sf):
    return sg.lfp(hourly(spark, sf), ["ch"], "s", "v", 1.0, 0.25).select("ch", "s", R6("v").alias("v"))


@query("WITH {spikes}, " + HOURS + convolved(sg.sinc_kernel(None, 0.05625, 1.0, 64)) + " SELECT ch, s // 8 AS s, round(v, 6) AS v FROM fl WHERE s % 8 = 0")
def o_sig_05_slow_signal(spark, sf):
    return sg.lfp(hourly(spark, sf), ["ch"], "s", "v", 1.0, 0.125).select("ch", "s", R6("v").alias("v"))


@query("WITH {spikes}, " + HOURS + """, o AS (SELECT i, i * 2.5 AS place FROM range(CAST(ceil((SELECT max(s) + 1 FROM sm) / 2.5) AS BIGINT)) r(i)), k AS (SELECT i, d, CAST(floor(place) AS BIGINT) + d AS s, floor(place) + d - place AS gap FROM o, range(-63, 65) q(d)),
 t AS (SELECT i, greatest(least(s, (SELECT max(s) FROM sm)), 0) AS s, CASE WHEN gap = 0 THEN 1 ELSE sin(pi() * 0.36 * gap) / (pi() * 0.36 * gap) END * (0.42 + 0.5 * cos(pi() * gap / 65) + 0.08 * cos(2 * pi() * gap / 65)) AS w FROM k)
 SELECT ch, i AS s, round(sum(v * w) / sum(w), 6) AS v FROM t JOIN sm USING (s) GROUP BY 1, 2""")
def o_sig_06_resampled(spark, sf):
    return sg.resampled(hourly(spark, sf), ["ch"], "s", "v", 1.0, 0.4).select("ch", "s", R6("v").alias("v"))


@query("WITH {spikes}, " + HOURS + convolved(sg.sinc_kernel(0.1, None, 1.0, 64)) + " SELECT ch, s, round(v, 6) AS v FROM fl")
def o_sig_17_high_pass(spark, sf):
    return sg.filtered(hourly(spark, sf), ["ch"], "s", "v", 0.1, None, 1.0, 64, 256).select("ch", "s", R6("v").alias("v"))


@query("WITH {spikes}, " + HOURS + ", x AS (SELECT ch, s, v - 30 < -20 AS d, lag(v - 30 < -20) OVER (PARTITION BY ch ORDER BY s) AS p FROM sm) SELECT ch, round(count(*) FILTER (d AND NOT coalesce(p, false)) / (max(s) - min(s) + 1), 6) AS rate FROM x GROUP BY ch HAVING count(*) FILTER (d AND NOT coalesce(p, false)) / (max(s) - min(s) + 1) >= 0.01")
def o_sig_20_good_channels(spark, sf):
    return sg.good_channels(hourly(spark, sf).withColumn("v", F.col("v") - 30), "s", "v", 20.0, 1.0, 0.01).withColumn("rate", R6("rate"))


@query("WITH {spikes}, " + HOURS + """, f AS (SELECT k, 0.02 * exp(ln(20.0) / 11 * k) AS f FROM range(12) r(k)), n AS (SELECT max(s) + 1 AS n FROM sm),
 g AS (SELECT k, f, f * (exp(ln(20.0) / 11) - 1) AS want, (1 + 0.5 * 9) / n AS a, (1 + 0.5 * 1) / n AS b FROM f, n), z AS (SELECT k, f, CAST(round_even(1 / CASE WHEN want >= a THEN want ELSE greatest(sqrt(a * want), b) END, 0) AS BIGINT) AS l FROM g),
 h AS (SELECT k, f, l, CAST(greatest(round_even(l * 0.5, 0), 1) AS BIGINT) AS hop FROM z), c AS (SELECT k, f, l, unnest(range(0, n - l + 1, hop)) AS start FROM h, n),
 x AS (SELECT ch, k, f, l, start, s - start AS i, v - avg(v) OVER (PARTITION BY ch, k, start) AS v FROM c JOIN sm ON s >= start AND s < start + l),
 p AS (SELECT ch, k, f, start, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / (l - 1))) * cos(2 * pi() * f * i)) ** 2 + sum(v * (0.5 - 0.5 * cos(2 * pi() * i / (l - 1))) * sin(2 * pi() * f * i)) ** 2 AS p FROM x GROUP BY 1, 2, 3, 4)
 SELECT ch, round(f, 6) AS freq, round(avg(p), 3) AS power FROM p GROUP BY ch, k, f""")
def o_sup_28_log_spectrum(spark, sf):
    return sg.log_spectrum(hourly(spark, sf), ["ch"], "s", "v", 1.0, 0.02, 0.4, 12, 10, 2).select("ch", R6("freq").alias("freq"), F.round("power", 3).alias("power"))


@query("WITH {spikes}, " + HOURS + ", w AS (SELECT ch, unnest(range(CAST(greatest(ceil((s - 23) / 8.0), 0) AS BIGINT), s // 8 + 1)) AS w, s, v FROM sm) SELECT ch, w AS \"window\", s - w * 8 AS place, round(v, 6) AS v FROM w")
def o_sup_23_overlapping(spark, sf):
    return sg.overlapping(hourly(spark, sf), "s", 24, 8).select("ch", "window", "place", R6("v").alias("v"))


#: Magnitudes at 0.01 * k, between the two nearest of 256 bins, of whole windows of 72 hours under a Hamming taper.
SPECTRA = """, wn AS (SELECT ch, s // 72 AS w, s % 72 AS i, v * (0.54 - 0.46 * cos(2 * pi() * (s % 72) / 71)) AS x FROM sm), fw AS (SELECT ch, w FROM wn GROUP BY 1, 2 HAVING count(*) = 72),
 fq AS (SELECT k, 0.01 * k AS freq, CAST(floor(2.56 * k) AS BIGINT) AS b, 2.56 * k - floor(2.56 * k) AS part FROM range(1, 41) r(k)), nb AS (SELECT DISTINCT b + d AS b FROM fq, range(2) r(d)),
 mg AS (SELECT ch, w, b, sqrt(sum(x * cos(2 * pi() * b * i / 256)) ** 2 + sum(x * sin(2 * pi() * b * i / 256)) ** 2) AS m FROM wn JOIN fw USING (ch, w), nb GROUP BY 1, 2, 3),
 sg AS (SELECT lo.ch, lo.w AS win, k, freq, lo.m * (1 - part) + hi.m * part AS magnitude FROM fq JOIN mg lo ON lo.b = fq.b JOIN mg hi ON hi.b = fq.b + 1 AND hi.ch = lo.ch AND hi.w = lo.w)"""


def spectra(spark, sf):
    return sg.spectrogram(hourly(spark, sf), ["ch"], "s", "v", 72, 1.0, [0.01 * k for k in range(1, 41)])


@query("WITH {spikes}, " + HOURS + SPECTRA + ' SELECT ch, win AS "window", round(freq, 6) AS freq, round(magnitude, 4) AS magnitude FROM sg')
def o_sig_07_spectrogram(spark, sf):
    return spectra(spark, sf).select("ch", "window", R6("freq").alias("freq"), F.round("magnitude", 4).alias("magnitude"))


@query("WITH {spikes}, " + HOURS + SPECTRA + ' SELECT ch, win AS "window", round(regr_slope(log10(magnitude), log10(freq)), 4) AS slope, round(regr_intercept(log10(magnitude), log10(freq)), 4) AS intercept FROM sg WHERE magnitude > 0 GROUP BY 1, 2')
def o_sig_08_spectrum_slope(spark, sf):
    line, _ = sg.spectrum_slope(spectra(spark, sf), ["ch", "window"], "freq", "magnitude")
    return line.select("ch", "window", *[F.round(c, 4).alias(c) for c in ("slope", "intercept")])


@query("WITH {spikes} SELECT unit, round(regr_slope(log10(v), log10(1 + id % 50)), 6) AS slope, round(regr_intercept(log10(v), log10(1 + id % 50)), 6) AS intercept FROM spikes WHERE v > 0 GROUP BY unit")
def o_sig_08_regression(spark, sf):
    s = spikes(spark, sf).select("unit", "id", "v", (1 + F.col("id") % 50).cast("double").alias("f"))
    line = s.filter("v > 0").groupBy("unit").agg(F.regr_slope(F.log10("v"), F.log10("f")).alias("slope"), F.regr_intercept(F.log10("v"), F.log10("f")).alias("intercept"))
    return line.select("unit", R6("slope").alias("slope"), R6("intercept").alias("intercept"))


CORR = """pr AS (SELECT a.s // 24 AS w, a.ch, b.ch AS other, corr(a.v, b.v) AS r FROM sm a JOIN sm b ON a.s = b.s AND a.ch < b.ch WHERE a.ch IN ('click', 'view', 'error') AND b.ch IN ('click', 'view', 'error') GROUP BY 1, 2, 3)"""


@query("WITH {spikes}, " + HOURS + ", " + CORR + " SELECT w AS window, round(avg(CASE WHEN r IS NULL OR isnan(r) THEN 0 ELSE r END), 5) AS correlation FROM pr GROUP BY 1")
def o_sig_10_pairwise_correlation(spark, sf):
    return sg.pairwise_correlation(hourly(spark, sf), "s", "v", 24, ["click", "view", "error"]).withColumn("correlation", F.round("correlation", 5))


@query("WITH {spikes}, " + HOURS + convolved(sg.sinc_kernel(0.15, 0.45, 1.0, 64)) + ", " + CORR.replace("FROM sm a JOIN sm b", "FROM fl a JOIN fl b") + " SELECT w AS window, round(avg(CASE WHEN r IS NULL OR isnan(r) THEN 0 ELSE r END), 4) AS correlation FROM pr GROUP BY 1")
def o_sig_11_emg(spark, sf):
    return sg.emg(hourly(spark, sf), "s", "v", 1.0, 24, ["click", "view", "error"]).withColumn("correlation", F.round("correlation", 4))


@query("SELECT min(s_suppkey) AS ch FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0 GROUP BY n_regionkey")
def o_sig_12_emg_channels(spark, sf):
    from .registry import channels

    c = channels(spark, sf)
    return sg.emg_channels(c, "probe", c.filter("ch % 7 = 0"))


#: The analytic signal of N samples: the imaginary part by the discrete Hilbert kernel, which differs for even and odd N.
PHASE = """, nn AS (SELECT count(DISTINCT s) AS n FROM sm), im AS (SELECT a.ch, a.s, any_value(a.v) AS re, sum(CASE WHEN (a.s - b.s) % 2 = 0 AND n % 2 = 0 OR a.s = b.s THEN 0
 WHEN n % 2 = 0 THEN b.v * 2 / n / tan(pi() * (a.s - b.s) / n) ELSE b.v / n * (1 / tan(pi() * (a.s - b.s) / n) - cos(pi() * (a.s - b.s)) / sin(pi() * (a.s - b.s) / n)) END) AS im FROM sm a JOIN sm b USING (ch), nn GROUP BY 1, 2),
 ph AS (SELECT ch, s, round(atan2(im, re), 5) AS v FROM im)"""


@query("WITH {spikes}, " + HOURS + PHASE + " SELECT ch, s, v FROM ph")
def o_sig_14_phase(spark, sf):
    return sg.analytic_phase(hourly(spark, sf), ["ch"], "s", "v", 1024, 128).select("ch", "s", F.round("v", 5).alias("v"))


@query("WITH {spikes}, " + HOURS + PHASE + ", d AS (SELECT m.ch, m.s, b.v - a.v + pi() AS d FROM sm m JOIN ph a ON a.ch = m.ch AND a.s = m.s - 1 JOIN ph b ON b.ch = m.ch AND b.s = m.s + 1 WHERE m.v > 60) SELECT ch, s AS peak, round(abs(d - floor(d / (2 * pi())) * 2 * pi() - pi()) / 2 / (2 * pi()), 5) AS frequency FROM d")
def o_sig_15_peak_frequency(spark, sf):
    events = hourly(spark, sf).filter("v > 60").select("ch", F.col("s").alias("peak"))
    return sg.peak_frequency(o_sig_14_phase(spark, sf), events, "s", "v", 1.0).select("ch", "peak", F.round("frequency", 5).alias("frequency"))


@query("WITH {spikes}, " + HOURS + " SELECT a.ch, b.ch AS other, round(avg(a.v * b.v), 5) AS moment FROM sm a JOIN sm b ON a.s = b.s GROUP BY 1, 2")
def o_sig_18_covariance(spark, sf):
    return sg.channel_covariance(hourly(spark, sf), "s", "v").withColumn("moment", F.round("moment", 5))


@query()
def o_sig_18_whitened(spark, sf):
    h = hourly(spark, sf)
    return sg.whitened(h, "s", "v", *sg.whitening_matrix(sg.channel_covariance(h, "s", "v")))


@query("WITH {spikes}, " + HOURS + " SELECT ch, s, v, min(v) OVER (PARTITION BY ch ORDER BY s ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS min FROM sm")
def o_sig_21_moving_min(spark, sf):
    return sg.moving(hourly(spark, sf), ["ch"], "s", "v", 3, "min").select("ch", "s", "v", "min")


@query("WITH {spikes}, " + HOURS + " SELECT ch, round(sqrt(avg(v * v)), 6) AS rms FROM sm GROUP BY ch")
def o_sig_22_rms(spark, sf):
    return sg.rms(hourly(spark, sf), ["ch"], "v").withColumn("rms", R6("rms"))


@query("WITH {spikes}, " + HOURS + " SELECT a.ch, b.ch AS other, round(corr(a.v, b.v), 5) AS r FROM sm a JOIN sm b ON a.s = b.s AND a.ch < b.ch GROUP BY 1, 2")
def o_sig_22_channel_correlation(spark, sf):
    return sg.channel_correlation(hourly(spark, sf), "s", "v").withColumn("r", F.round("r", 5))


@query("WITH {spikes}, " + HOURS + ", x AS (SELECT s, v FROM sm WHERE ch = 'click'), y AS (SELECT s, v FROM sm WHERE ch = 'view'), sc AS (SELECT d AS shift, sum(x.v * y.v) AS score FROM range(-12, 13) r(d), x JOIN y ON x.s = y.s + d GROUP BY 1) SELECT CAST(shift AS INT) AS shift, round(score, 3) AS score FROM sc ORDER BY sc.score DESC, abs(sc.shift), sc.shift LIMIT 1")
def o_sig_22_time_offset(spark, sf):
    h = hourly(spark, sf)
    return sg.time_offset(h.filter("ch = 'click'"), h.filter("ch = 'view'"), "s", "v", 12).withColumn("score", F.round("score", 3))


@query("WITH {spikes}, " + HOURS + ", " + CONTACTS_SQL + ", f AS (SELECT y, s, v - avg(v) OVER (PARTITION BY ch) AS v FROM sm JOIN ct USING (ch)), c AS (SELECT y, s, -(lag(v) OVER w - 2 * v + lead(v) OVER w) AS csd FROM f WINDOW w AS (PARTITION BY s ORDER BY y)) SELECT CAST(y AS DOUBLE) AS y, s, round(csd, 6) AS csd FROM c WHERE csd IS NOT NULL")
def o_sig_23_csd(spark, sf):
    h = hourly(spark, sf).join(contacts(spark, sf), "ch")
    return sg.current_source_density(h, [], "y", "s", "v").select("y", "s", R6("csd").alias("csd"))


# ---- states

SCORES = "sc AS (SELECT s, max(v) FILTER (ch = 'click') AS sw, max(v) FILTER (ch = 'view') AS emg, max(v) FILTER (ch = 'error') AS theta FROM sm GROUP BY s), st AS (SELECT s, sw, emg, theta, CASE WHEN sw > 25 THEN 'NREM' WHEN emg < 20 AND theta > 15 THEN 'REM' ELSE 'WAKE' END AS state FROM sc)"


def scored(spark, sf):
    wide = hourly(spark, sf).groupBy("s").agg(*[F.max(F.when(F.col("ch") == c, F.col("v"))).alias(n) for c, n in (("click", "sw"), ("view", "emg"), ("error", "theta"))])
    return ss.classify(wide, "sw", "emg", "theta", 25.0, 20.0, 15.0)


RUNS = ", rf AS (SELECT *, CASE WHEN state = lag(state) OVER (ORDER BY s) THEN 0 ELSE 1 END AS fresh FROM st), rg AS (SELECT *, sum(fresh) OVER (ORDER BY s) AS run FROM rf), iv AS (SELECT state, min(s) AS start, max(s) AS stop FROM rg GROUP BY run, state)"


def state_spans(spark, sf):
    return runs(scored(spark, sf), [], "s", "state", 48).select("state", "start", "stop")


@query("WITH {spikes}, " + HOURS + ", " + SCORES + " SELECT s, state FROM st")
def o_st_09_classify(spark, sf):
    return scored(spark, sf).select("s", "state")


@query("WITH {spikes}, " + HOURS + ", " + SCORES + RUNS + " SELECT state, start, stop FROM iv")
def o_st_07_index_to_intervals(spark, sf):
    return state_spans(spark, sf)


@query("WITH {spikes}, " + HOURS + ", " + SCORES + RUNS + ", w AS (SELECT state, CAST(round_even(start * 1.5, 0) AS BIGINT) AS a, CAST(round_even(stop * 1.5, 0) AS BIGINT) AS b FROM iv), x AS (SELECT unnest(range(a, b + 1)) AS s, CASE state WHEN 'WAKE' THEN 1 WHEN 'NREM' THEN 3 ELSE 5 END AS code FROM w) SELECT s, max(code) AS code FROM x GROUP BY s")
def o_st_08_intervals_to_index(spark, sf):
    spans = state_spans(spark, sf).select("state", (F.col("start") * 1.5).alias("start"), (F.col("stop") * 1.5).alias("stop"))
    return ss.intervals_to_index(spans, [], {"WAKE": 1, "NREM": 3, "REM": 5})


@query("WITH {spikes}, " + HOURS + ", " + SCORES + RUNS + " SELECT s, CASE WHEN EXISTS (SELECT 1 FROM iv WHERE state = 'REM' AND st.s BETWEEN start - 1 AND stop + 1) THEN 'MIXED' ELSE state END AS state FROM st")
def o_st_10_overwrite(spark, sf):
    rem = state_spans(spark, sf).filter("state = 'REM'").select((F.col("start") - 1).alias("start"), (F.col("stop") + 1).alias("stop"))
    return ss.overwrite(scored(spark, sf).select("s", "state"), rem, [], "s", "state", "MIXED", 48)


@query("WITH {spikes}, " + HOURS + ", " + SCORES + RUNS + " SELECT 'packets' AS kind, start, stop FROM iv WHERE state = 'NREM' AND stop - start >= 2 UNION ALL SELECT 'microarousals', start, stop FROM iv WHERE state = 'WAKE' AND stop - start <= 1 UNION ALL SELECT 'wake_episodes', start, stop FROM iv WHERE state = 'WAKE' AND stop - start > 1")
def o_st_12_episodes(spark, sf):
    e = ss.episodes(state_spans(spark, sf), [], 2, 1, 48)
    pick = lambda k: e[k].select(F.lit(k).alias("kind"), "start", "stop")
    return pick("packets").union(pick("microarousals")).union(pick("wake_episodes"))


@query()
def o_st_12_nrem_episodes(spark, sf):
    return ss.episodes(state_spans(spark, sf), [], 2, 3, 48)["nrem_episodes"]


@query("WITH {spikes}, " + HOURS + ", " + SCORES + " SELECT s, CASE WHEN theta > 20 AND emg > 15 THEN 7 WHEN state = 'WAKE' AND theta <= 20 THEN 9 WHEN state = 'WAKE' THEN 1 WHEN state = 'NREM' THEN 3 ELSE 5 END AS code FROM st")
def o_st_13_theta_epochs(spark, sf):
    return ss.theta_epochs(scored(spark, sf), "state", "theta", "emg", 20.0, 15.0).select("s", "code")


@query("WITH {spikes}, " + HOURS + SPECTRA + """, lg AS (SELECT ch, win, freq, log10(magnitude) AS p, row_number() OVER (PARTITION BY ch, win ORDER BY freq) AS r FROM sg WHERE magnitude > 0), rs AS (SELECT a.ch, a.win, a.freq, any_value(a.p) - median(b.p) AS x FROM lg a JOIN lg b ON a.ch = b.ch AND a.win = b.win AND abs(a.r - b.r) BETWEEN 1 AND 2 GROUP BY 1, 2, 3)
 SELECT ch, win AS "window", round(max(x) FILTER (freq BETWEEN 0.0499999 AND 0.1000001), 4) AS peak, round(sum(greatest(x, 0)) FILTER (freq BETWEEN 0.0499999 AND 0.1000001) / nullif(sum(greatest(x, 0)), 0), 4) AS share FROM rs GROUP BY 1, 2""")
def o_st_02_theta_score(spark, sf):
    _, flat = sg.spectrum_slope(spectra(spark, sf), ["ch", "window"], "freq", "magnitude")
    return ss.theta_score(flat, ["ch", "window"], "freq", "residual", 0.0499999, 0.1000001).select("ch", "window", F.round("peak", 4).alias("peak"), F.round("share", 4).alias("share"))


@query()
def o_st_03_dip(spark, sf):
    return ss.bimodality(hourly(spark, sf), ["ch"], "v")


@query()
def o_st_04_best_channel(spark, sf):
    return ss.best_channel(ss.bimodality(hourly(spark, sf), ["ch"], "v"), "ch", "dip")


VALLEY = """, e AS (SELECT ch, min(v) AS lo, max(v) AS hi FROM spikes GROUP BY ch HAVING max(v) > min(v)), g AS (SELECT ch, lo, hi, bins, unnest(range(bins)) AS bin FROM e, range(12, 31) r(bins)),
 c AS (SELECT ch, bins, CAST(least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM spikes JOIN e USING (ch), range(12, 31) r(bins) GROUP BY 1, 2, 3), h AS (SELECT ch, lo, hi, bins, bin, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (ch, bins, bin)),
 p AS (SELECT *, n > coalesce(lag(n) OVER w, -1) AND n > coalesce(lead(n) OVER w, -1) AS peak FROM h WINDOW w AS (PARTITION BY ch, bins ORDER BY bin)), two AS (SELECT ch, bins, min(bin) AS a, max(bin) AS b FROM p WHERE peak GROUP BY 1, 2 HAVING count(*) = 2), f AS (SELECT ch, min(bins) AS bins FROM two GROUP BY 1),
 v AS (SELECT p.ch, p.bins, arg_min(p.bin, (p.n, p.bin)) AS bin, any_value(lo) AS lo, any_value(hi) AS hi FROM p JOIN f USING (ch, bins) JOIN two USING (ch, bins) WHERE p.bin BETWEEN a AND b GROUP BY 1, 2)
 SELECT ch, CAST(v.bins AS INT) AS bins, round(coalesce(v.lo + (v.bin + 0.5) * (v.hi - v.lo) / v.bins, (e.lo + e.hi) / 2), 6) AS threshold FROM e LEFT JOIN v USING (ch)"""


@query("WITH {spikes}" + VALLEY)
def o_st_05_valley_threshold(spark, sf):
    return ss.valley_threshold(spikes(spark, sf).select("ch", "v"), ["ch"], "v").select("ch", F.col("bins").cast("int").alias("bins"), R6("threshold").alias("threshold"))


@query("WITH {spikes}, " + HOURS + ", " + SCORES + RUNS + ", o AS (SELECT state, CAST(sum(stop - start) AS BIGINT) AS seconds FROM iv GROUP BY 1) SELECT state, seconds, round(seconds / sum(seconds) OVER (), 6) AS share FROM o")
def o_st_11_state_fractions(spark, sf):
    one = state_spans(spark, sf).withColumn("session", F.lit(1))
    return ss.state_fractions(one, ["session"]).select("state", "seconds", R6("share").alias("share"))


@query("WITH {spikes}" + VALLEY.replace("ch,", "u,").replace("(ch, bins", "(u, bins").replace("USING (ch)", "USING (u)").replace("BY ch", "BY u").replace("SELECT ch", "SELECT u").replace("p.ch", "p.u").replace("FROM spikes", "FROM (SELECT unit % 7 AS u, v FROM spikes)").replace("(FROM", "FROM"))
def o_st_06_bimodal_threshold(spark, sf):
    rows = spikes(spark, sf).select((F.col("unit") % 7).alias("u"), "v")
    return ss.valley_threshold(rows, ["u"], "v").select("u", F.col("bins").cast("int").alias("bins"), R6("threshold").alias("threshold"))
