"""Queries of the sequence operators, and the flagship: unit quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as sq
from ..session import table
from .registry import DAY, HOUR, query, spikes
from .stat_queries import LABELLED, R6, labelled

ISI = "i AS (SELECT *, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b FROM spikes WINDOW w AS (PARTITION BY unit ORDER BY t, id))"
TRAIN = f"""train AS (SELECT unit, count(*) AS n, 1 / median(a) AS isi_rate, avg(CASE WHEN 2 * abs(a - b) / (a + b) < 1.95 THEN 2 * abs(a - b) / (a + b) END) AS cv2,
 CASE WHEN count(*) > 1 THEN count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND (a < {HOUR} OR b < {HOUR})) / (count(*) - 1) END AS burst_index, 1000 * count(*) FILTER (a < {HOUR // 4}) / count(*) AS refractory_per_mille FROM i GROUP BY unit)"""


def train(spark, sf):
    return sq.spike_train_metrics(spikes(spark, sf), ["unit"], "t", HOUR, HOUR // 4, DAY, ("id",))


@query("WITH {spikes}, " + ISI + ", " + TRAIN + ", " + LABELLED + """
 SELECT unit, n, round(cv2, 6) AS cv2, round(burst_index, 6) AS burst_index, round(refractory_per_mille, 6) AS refractory_per_mille,
 CASE WHEN coalesce(burst_index > 0.2, false) OR coalesce(refractory_per_mille > 40, false) OR coalesce(n < 45, false) THEN 'noise' ELSE coalesce(label, 'unsorted') END AS label FROM train LEFT JOIN lab USING (unit)""")
def unit_quality(spark, sf):
    """Per unit: spike train metrics and the label after the noise rules."""
    noise = F.coalesce(F.col("burst_index") > 0.2, F.lit(False)) | F.coalesce(F.col("refractory_per_mille") > 40, F.lit(False)) | F.coalesce(F.col("n") < 45, F.lit(False))
    rows = train(spark, sf).join(labelled(spark, sf), "unit", "left")
    return rows.select("unit", "n", R6("cv2").alias("cv2"), R6("burst_index").alias("burst_index"), R6("refractory_per_mille").alias("refractory_per_mille"), F.when(noise, "noise").otherwise(F.coalesce("label", F.lit("unsorted"))).alias("label"))


@query("WITH {spikes}, b AS (SELECT unit, t, (v >= 20)::INT AS bit FROM spikes), e AS (SELECT unit, t, lead(bit) OVER (PARTITION BY unit ORDER BY t) - bit AS edge FROM b) SELECT * FROM e WHERE edge IN (1, -1)")
def o_win_01_edges(spark, sf):
    return sq.edges(spikes(spark, sf).select("unit", "t", (F.col("v") >= 20).cast("int").alias("bit")), ["unit"], "t", "bit", DAY)


@query("WITH {spikes}, " + ISI + ", " + TRAIN + " SELECT unit, n, round(isi_rate * 1e9, 6) AS isi_rate, round(cv2, 6) AS cv2, round(burst_index, 6) AS burst_index, round(refractory_per_mille, 6) AS refractory_per_mille FROM train")
def o_win_02_spike_train_metrics(spark, sf):
    return train(spark, sf).select("unit", "n", R6(F.col("isi_rate") * 1e9).alias("isi_rate"), R6("cv2").alias("cv2"), R6("burst_index").alias("burst_index"), R6("refractory_per_mille").alias("refractory_per_mille"))


@query("WITH {spikes}, " + ISI + ", s AS (SELECT unit, CASE WHEN v < 15 THEN 'low' ELSE 'high' END AS state, a FROM i) SELECT unit, count(a) FILTER (state = 'low') AS n_low, count(a) FILTER (state = 'high') AS n_high, round(median(a) FILTER (state = 'low'), 1) AS isi_low, round(median(a) FILTER (state = 'high'), 1) AS isi_high FROM s GROUP BY unit")
def o_win_05_metrics_by_state(spark, sf):
    rows = sq.intervals_between(spikes(spark, sf), ["unit"], "t", DAY, ("id",)).withColumn("state", F.when(F.col("v") < 15, "low").otherwise("high"))
    return rows.groupBy("unit").pivot("state", ["low", "high"]).agg(F.count("isi").alias("n"), F.round(F.median("isi"), 1).alias("isi")).select("unit", F.coalesce("low_n", F.lit(0)).alias("n_low"), F.coalesce("high_n", F.lit(0)).alias("n_high"), F.col("low_isi").alias("isi_low"), F.col("high_isi").alias("isi_high"))


@query("""WITH {spikes}, s AS (SELECT unit, t, CASE WHEN t - lag(t) OVER w IS NULL THEN 0.0 ELSE sqrt((v - lag(v) OVER w) ** 2 + (id % 97 - lag(id % 97) OVER w) ** 2) / ((t - lag(t) OVER w) / 3600000000.0) END AS speed FROM spikes WINDOW w AS (PARTITION BY unit ORDER BY t))
 SELECT unit, t, round(speed, 6) AS speed, round(coalesce(speed - lag(speed) OVER (PARTITION BY unit ORDER BY t), 0), 6) AS acceleration FROM s""")
def o_win_06_speed(spark, sf):
    track = spikes(spark, sf).select("unit", "t", F.col("v").alias("x"), (F.col("id") % 97).cast("double").alias("y"))
    return sq.speed(track, ["unit"], "t", "x", "y", HOUR * 1.0, DAY).select("unit", "t", R6("speed").alias("speed"), R6("acceleration").alias("acceleration"))


GAPPED = "g AS (SELECT unit, t, CASE WHEN v < 12 THEN NULL ELSE v END AS v FROM spikes)"


def gapped(spark, sf):
    return spikes(spark, sf).select("unit", "t", F.when(F.col("v") >= 12, F.col("v")).alias("v"))


@query("WITH {spikes}, " + GAPPED + f""", n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER lo AS t0, last_value(v IGNORE NULLS) OVER lo AS v0, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER hi AS t1, first_value(v IGNORE NULLS) OVER hi AS v1 FROM g
 WINDOW lo AS (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING), hi AS (PARTITION BY unit ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT unit, t, round(CASE WHEN v IS NOT NULL THEN v WHEN t1 - t0 <= {12 * HOUR} THEN v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END, 6) AS v FROM n""")
def o_win_07_fill_gaps(spark, sf):
    return sq.fill_gaps(gapped(spark, sf), ["unit"], "t", "v", 12 * HOUR, DAY).select("unit", "t", R6("v").alias("v"))


@query("WITH {spikes} SELECT unit, t, round(sum(v) OVER (PARTITION BY unit ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6, 6) AS smooth FROM spikes")
def o_win_09_moving_average(spark, sf):
    return sq.moving_average(spikes(spark, sf).select("unit", "t", "v"), ["unit"], "t", "v", 6, width=DAY).select("unit", "t", R6("smooth").alias("smooth"))


@query("WITH {spikes}, " + GAPPED + " SELECT unit, t, round(avg(v) OVER (PARTITION BY unit ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM g")
def o_win_10_centred_mean(spark, sf):
    return sq.centred_mean(gapped(spark, sf), ["unit"], "t", "v", 5, width=DAY).select("unit", "t", R6("smooth").alias("smooth"))


@query("""WITH {spikes}, s AS (SELECT unit, t, CASE WHEN v < 10 THEN 0 ELSE 1 + id % 3 END AS state, row_number() OVER (PARTITION BY unit ORDER BY t) AS i FROM spikes),
 n AS (SELECT *, last_value(CASE WHEN state <> 0 THEN struct_pack(i := i, s := state) END IGNORE NULLS) OVER lo AS l, first_value(CASE WHEN state <> 0 THEN struct_pack(i := i, s := state) END IGNORE NULLS) OVER hi AS h FROM s
 WINDOW lo AS (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING), hi AS (PARTITION BY unit ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT unit, t, CASE WHEN state <> 0 THEN state WHEN l IS NOT NULL AND (h IS NULL OR i - l.i <= h.i - i) THEN l.s ELSE coalesce(h.s, 0) END AS state FROM n""")
def o_win_11_fill_states(spark, sf):
    rows = spikes(spark, sf).select("unit", "t", F.when(F.col("v") < 10, F.lit(0).cast("long")).otherwise(1 + F.col("id") % 3).alias("state"))
    return sq.fill_states(rows, ["unit"], "t", "state", DAY)


def _rewritten(passes):
    """Common table expressions: each pass rewrites runs of a state that are too short, runs taken anew."""
    out = ["w0 AS (SELECT unit, t, CAST(1 + id % 3 AS INT) AS state FROM spikes)"]
    for i, (code, into, least) in enumerate(passes):
        out.append(f"f{i} AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY unit ORDER BY t) THEN 0 ELSE 1 END AS fresh FROM w{i}), g{i} AS (SELECT *, sum(fresh) OVER (PARTITION BY unit ORDER BY t) AS run FROM f{i})")
        out.append(f"w{i + 1} AS (SELECT unit, t, CASE WHEN state = {code} AND count(*) OVER (PARTITION BY unit, run) < {least} THEN {into} ELSE state END AS state FROM g{i})")
    return ", ".join(out)


@query("WITH {spikes}, " + _rewritten([(1, 2, 2), (3, 1, 2), (2, 3, 2)]) + " SELECT unit, t, CAST(state AS INT) AS state FROM w3")
def o_win_12_minimum_durations(spark, sf):
    rows = spikes(spark, sf).select("unit", "t", (1 + F.col("id") % 3).cast("int").alias("state"))
    return sq.event_duration_states(rows, ["unit"], "t", "state", {1: 2, 2: 2, 3: 2}, [(1, 2), (3, 1), (2, 3)], DAY)


@query(f"""WITH RECURSIVE {{spikes}}, w AS (SELECT unit, t, ['WAKE', 'NREM', 'REM'][1 + id % 3] AS state FROM spikes), f AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY unit ORDER BY t) THEN 0 ELSE 1 END AS fresh FROM w), g AS (SELECT *, sum(fresh) OVER (PARTITION BY unit ORDER BY t) AS run FROM f),
 r AS (SELECT unit, run AS i, any_value(state) AS state, min(t) AS start, max(t) AS stop FROM g GROUP BY 1, 2),
 k AS (SELECT unit, i, state, start, stop, stop - start AS length FROM r WHERE i = 1 UNION ALL SELECT unit, i, new, start, stop, CASE WHEN new = before THEN length ELSE 0 END + stop - start FROM
 (SELECT r.unit, r.i, r.start, r.stop, k.state AS before, k.length, CASE WHEN r.state = 'REM' AND k.state = 'WAKE' AND k.length > {6 * HOUR} THEN 'WAKE' ELSE r.state END AS new FROM k JOIN r ON r.unit = k.unit AND r.i = k.i + 1)) SELECT unit, state, start, stop FROM k""")
def o_win_13_suppress_transitions(spark, sf):
    from ..operators.intervals import runs

    rows = spikes(spark, sf).select("unit", "t", F.element_at(F.array(F.lit("WAKE"), F.lit("NREM"), F.lit("REM")), (1 + F.col("id") % 3).cast("int")).alias("state"))
    return sq.suppress_transitions(runs(rows, ["unit"], "t", "state", DAY).select("unit", "state", "start", "stop"), ["unit"], "WAKE", "REM", "WAKE", 6 * HOUR)


@query("""WITH RECURSIVE {spikes}, m AS (SELECT DISTINCT ch, t // 60000000 AS s FROM spikes), g AS (SELECT ch, s, s // 60 AS hour, s - row_number() OVER (PARTITION BY ch, s // 60 ORDER BY s) AS run, row_number() OVER (PARTITION BY ch, s // 60 ORDER BY s) AS i FROM m), sp AS (SELECT ch, min(s) AS start, max(s) AS stop FROM g GROUP BY ch, hour),
 k AS (SELECT ch, min(start) AS t FROM sp GROUP BY ch UNION ALL SELECT k.ch, (SELECT min(greatest(sp.start, k.t + 31)) FROM sp WHERE sp.ch = k.ch AND sp.stop >= k.t + 31) FROM k WHERE k.t IS NOT NULL) SELECT ch, t FROM k WHERE t IS NOT NULL""")
def o_win_14_dead_time(spark, sf):
    from ..operators.intervals import runs

    flags = spikes(spark, sf).select("ch", F.floor(F.col("t") / 60_000_000).alias("s")).distinct()
    spans = runs(flags.withColumn("one", F.lit(1)).withColumn("hour", F.floor(F.col("s") / 60)), ["ch", "hour"], "s", "one").select("ch", F.col("start"), F.col("stop"))
    return sq.expand_runs_with_dead_time(spans, ["ch"], 30)


THINNED = """WITH RECURSIVE {spikes}, e AS (SELECT DISTINCT ch, t FROM spikes), k AS (SELECT ch, min(t) AS t FROM e GROUP BY ch
 UNION ALL SELECT k.ch, (SELECT min(e.t) FROM e WHERE e.ch = k.ch AND e.t >= k.t + 21600000000) FROM k WHERE k.t IS NOT NULL) SELECT ch, t FROM k WHERE t IS NOT NULL"""


@query(THINNED)
def o_win_15_greedy_thin(spark, sf):
    return sq.greedy_thin(spikes(spark, sf), ["ch"], "t", 6 * HOUR, DAY)


TEMPLATES = "tp AS (SELECT unit, unit % 10 * 30.0 AS x, unit // 10 * 30.0 AS y, count(*) AS size FROM spikes GROUP BY unit)"


@query("WITH {spikes}, " + TEMPLATES + """, p AS (SELECT * FROM spikes JOIN tp USING (unit)) SELECT unit, t, id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE abs(a.t - b.t) <= 600000000 AND (b.size > a.size OR (b.size = a.size AND b.unit < a.unit)) AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 100)""")
def o_win_17_close_pairs_removed(spark, sf):
    s = spikes(spark, sf).select("unit", "t", "id")
    tp = s.groupBy("unit").agg(F.count(F.lit(1)).alias("size")).select("unit", (F.col("unit") % 10 * 30.0).alias("x"), (F.floor(F.col("unit") / 10) * 30.0).alias("y"), "size")
    return sq.close_pairs_removed(s, tp, "unit", "t", 600_000_000, 100.0)


@query("""WITH {spikes}, s AS (SELECT unit, t, v, row_number() OVER (PARTITION BY unit ORDER BY t) AS i FROM (SELECT unit, t, floor(v / 10) AS v FROM spikes)),
 f AS (SELECT *, sum(CASE WHEN v = pv THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY i) AS r FROM (SELECT *, lag(v) OVER (PARTITION BY unit ORDER BY i) AS pv FROM s)),
 g AS (SELECT unit, r, v, min(i) AS a, max(i) AS b FROM f GROUP BY 1, 2, 3), p AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS n FROM g WINDOW w AS (PARTITION BY unit ORDER BY r))
 SELECT s.unit, s.t, CAST(s.v AS BIGINT) AS v FROM p JOIN s ON p.unit = s.unit AND s.i = (a + b) // 2 WHERE p.v > l AND p.v > n""")
def o_win_19_local_maxima(spark, sf):
    return sq.local_maxima(spikes(spark, sf).select("unit", "t", F.floor(F.col("v") / 10).alias("v")), ["unit"], "t", "v", DAY)


@query("""WITH {spikes}, e AS (SELECT id AS event, t AS start, t + 1800000000 AS stop FROM spikes WHERE ch = 'purchase'), f AS (SELECT event, unit, min(t) AS first FROM spikes JOIN e ON t BETWEEN start AND stop GROUP BY 1, 2),
 r AS (SELECT unit, rank() OVER (PARTITION BY event ORDER BY first) / count(*) OVER (PARTITION BY event) AS r, count(*) OVER (PARTITION BY event) AS n FROM f)
 SELECT unit, round(median(r), 6) AS rank_order, count(*) AS n_events FROM r WHERE n >= 3 GROUP BY unit""")
def o_win_20_rank_in_events(spark, sf):
    s = spikes(spark, sf)
    e = s.filter("ch = 'purchase'").select(F.col("id").alias("event"), F.col("t").alias("start"), (F.col("t") + HOUR // 2).alias("stop"))
    return sq.rank_in_events(s.select("unit", "t"), e, "t", HOUR // 2, 3).withColumn("rank_order", R6("rank_order"))


@query("WITH {spikes}, r AS (SELECT unit, t, row_number() OVER w AS i, count(*) OVER (PARTITION BY unit) AS n FROM spikes WINDOW w AS (PARTITION BY unit ORDER BY t)) SELECT unit, t FROM r WHERE n <= 20 OR floor(i * 20 / n) > floor((i - 1) * 20 / n)")
def o_win_21_thin_evenly(spark, sf):
    return sq.thin_evenly(spikes(spark, sf).select("unit", "t"), ["unit"], "t", 20, DAY)


@query("""WITH {spikes}, p AS (SELECT unit, t, v, lag(v) OVER (PARTITION BY unit ORDER BY t) AS pv FROM spikes), b AS (SELECT unit, t FROM p WHERE pv <= 5 AND v > 5), e AS (SELECT unit, t FROM p WHERE pv <= 25 AND v > 25),
 f AS (SELECT unit, (SELECT max(b.t) FROM b WHERE b.unit = e.unit AND b.t <= e.t) AS start, t AS stop FROM e) SELECT unit, start, min(stop) AS stop FROM f WHERE start IS NOT NULL GROUP BY 1, 2""")
def o_win_22_trials(spark, sf):
    return sq.trials(spikes(spark, sf).select("unit", "t", "v"), ["unit"], "t", "v", 5.0, 25.0, DAY)


@query("WITH {spikes} SELECT unit, t, id, row_number() OVER (PARTITION BY unit ORDER BY t, id) AS n FROM spikes")
def o_srtg_01_stable_order(spark, sf):
    from ..operators.ordered import rank_of

    return rank_of(spikes(spark, sf).select("unit", "t", "id"), ["unit"], "t", ["id"], "n", DAY)


@query("WITH {spikes} SELECT ch, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, ch) AS place FROM spikes GROUP BY ch")
def o_srtg_03_order_by_count(spark, sf):
    from pyspark.sql import Window

    n = spikes(spark, sf).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))  # one row a channel
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "ch")).cast("long"))


@query("WITH {spikes}, r AS (SELECT unit, id, row_number() OVER (PARTITION BY unit ORDER BY sha256(CAST(id AS VARCHAR)), id) AS r FROM spikes) SELECT unit, id FROM r WHERE r <= 5")
def o_srtg_04_sampled_limit(spark, sf):
    from ..operators.stats import position_in_key

    s = spikes(spark, sf).select("unit", "id", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    return position_in_key(s, ["unit"], [F.col("h"), F.col("id")], 5).select("unit", "id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o_srtg_02_ordered_limit(spark, sf):
    from ..operators.stats import global_top

    return global_top(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100)
