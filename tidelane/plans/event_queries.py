"""Queries of the event, partition and filter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import filters as fl
from ..operators import intervals as iv
from ..operators import partitions as pt
from ..session import table
from .interval_queries import SPANS, spans
from .registry import CHANNELS_SQL, DAY, HOUR, channels, query, spikes
from .stat_queries import R6

# ---- events

WORDS = "words AS (SELECT ch, t, id % 8 AS word FROM spikes)"


@query("WITH {spikes}, " + WORDS + """, b AS (SELECT ch, t, bit, (word >> bit) & 1 AS x FROM words, range(3) r(bit)), e AS (SELECT ch, bit, t, lead(x) OVER (PARTITION BY ch, bit ORDER BY t) - x AS edge FROM b),
 f AS (SELECT ch, bit, t, edge = first_value(edge) OVER (PARTITION BY ch, bit ORDER BY t) AS ison FROM e WHERE edge IN (1, -1)),
 o AS (SELECT ch, bit, t AS start, row_number() OVER (PARTITION BY ch, bit ORDER BY t) AS n FROM f WHERE ison), x AS (SELECT ch, bit, t AS stop, row_number() OVER (PARTITION BY ch, bit ORDER BY t) AS n FROM f WHERE NOT ison)
 SELECT ch, CAST(bit AS INT) AS bit, n, start, stop, stop - start AS duration FROM o LEFT JOIN x USING (ch, bit, n)""")
def o_evt_01_digital_pulses(spark, sf):
    words = spikes(spark, sf).select("ch", "t", (F.col("id") % 8).alias("word"))
    return ev.digital_pulses(words, ["ch"], "t", "word", 3, DAY)


@query("WITH {spikes}, " + WORDS + ", w AS (SELECT ch, t AS start, coalesce(lead(t) OVER (PARTITION BY ch ORDER BY t), 1706745600000000) - 1 AS stop, word FROM words) SELECT * FROM w WHERE stop >= start")
def o_evt_02_word_intervals(spark, sf):
    words = spikes(spark, sf).select("ch", "t", (F.col("id") % 8).alias("word"))
    return ev.word_intervals(words, ["ch"], "t", "word", F.lit(1706745600000000), DAY)


@query("WITH {spikes} SELECT k.unit, k.t, coalesce((SELECT s.id % 8 FROM spikes s WHERE s.unit = k.unit AND s.ch = 'view' AND s.t <= k.t ORDER BY s.t DESC LIMIT 1), 0) AS word FROM spikes k WHERE ch = 'click'")
def o_evt_03_words_on_grid(spark, sf):
    s = spikes(spark, sf)
    return ev.words_on_grid(s.filter("ch = 'click'").select("unit", "t"), s.filter("ch = 'view'").select("unit", "t", (F.col("id") % 8).alias("word")), ["unit"], "t", "word", DAY)


@query("WITH {spikes} SELECT id, round((v * 1000 - 6800) * (5.0 / 52200.0), 6) AS v, round(id / 1250.0, 6) AS t FROM spikes")
def o_evt_04_rescale_analog(spark, sf):
    s = spikes(spark, sf).select("id", (F.col("v") * 1000).alias("v"))
    return ev.rescale_analog(s, "v", sample="id").select("id", R6("v").alias("v"), R6("t").alias("t"))


@query()
def o_evt_05_analog_pulses(spark, sf):
    s = spikes(spark, sf).select("unit", "t", F.col("v").alias("x"))
    return ev.analog_pulses(s, ["unit"], "t", "x", 0.3, 1.5, 0.4, 0, DAY)


@query("WITH {spikes} SELECT DISTINCT CAST(round_even(v * 3, 0) AS BIGINT) AS sample FROM spikes WHERE ch IN ('click', 'view')")
def o_evt_07_triggers(spark, sf):
    s = spikes(spark, sf)
    return ev.triggers(s.filter("ch = 'click'").select("v"), s.filter("ch = 'view'").select("v"), "v", 3.0)


LOUD = """, m AS (SELECT t // 3600000000 AS hour, median(abs(v)) AS m FROM spikes GROUP BY 1), th AS (SELECT 1.2 * 1.4826 * median(m) AS threshold FROM m),
 f AS (SELECT hour, m > threshold AS up, CASE WHEN (m > threshold) = lag(m > threshold) OVER (ORDER BY hour) THEN 0 ELSE 1 END AS fresh FROM m, th), g AS (SELECT *, sum(fresh) OVER (ORDER BY hour) AS run FROM f),
 loud AS (SELECT min(hour) AS start, max(hour) AS stop FROM g WHERE up GROUP BY run)"""


def loud(spark, sf):
    s = spikes(spark, sf).select(F.floor(F.col("t") / HOUR).alias("hour"), "ch", "v")
    return ev.high_amplitude_runs(s, [], "hour", "v", ev.amplitude_threshold(s, "hour", "v", 1.2), 24)


@query("WITH {spikes}" + LOUD + " SELECT start, stop FROM loud")
def o_evt_08_high_amplitude_runs(spark, sf):
    return loud(spark, sf)


@query("WITH RECURSIVE {spikes}" + LOUD + """, k AS (SELECT min(start) AS t FROM loud UNION ALL SELECT (SELECT min(start) FROM loud WHERE start >= k.t + 12) FROM k WHERE k.t IS NOT NULL) SELECT t FROM k WHERE t IS NOT NULL""")
def o_evt_08_artifact_triggers(spark, sf):
    return ev.artifact_triggers(loud(spark, sf), [], 12, 24)


@query("""WITH {spikes}, g AS (SELECT unit, t, CASE WHEN EXISTS (SELECT 1 FROM spikes e WHERE e.unit = s.unit AND e.ch = 'error' AND s.t BETWEEN e.t - 3600000000 AND e.t + 7200000000) THEN NULL ELSE v END AS x, v FROM spikes s),
 n AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER lo AS t0, last_value(x IGNORE NULLS) OVER lo AS v0, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER hi AS t1, first_value(x IGNORE NULLS) OVER hi AS v1 FROM g
 WINDOW lo AS (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING), hi AS (PARTITION BY unit ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT unit, t, round(coalesce(x, v0 + (v1 - v0) * ((t - t0) / (t1 - t0)), v), 6) AS v FROM n""")
def o_evt_09_blank_artifacts(spark, sf):
    s = spikes(spark, sf)
    return ev.blank_artifacts(s.select("unit", "t", "v"), s.filter("ch = 'error'").select("unit", "t"), ["unit"], "t", "v", HOUR, 2 * HOUR, DAY).select("unit", "t", R6("v").alias("v"))


@query("WITH {spikes} SELECT unit, list_sort(list(DISTINCT t)) AS samples FROM spikes WHERE ch = 'error' GROUP BY unit")
def o_evt_10_frames_by_group(spark, sf):
    return spikes(spark, sf).filter("ch = 'error'").groupBy("unit").agg(F.sort_array(F.collect_set("t")).alias("samples"))


@query("""WITH {spikes}, m AS (SELECT unit, avg(v) AS m, stddev_samp(v) AS s FROM spikes GROUP BY unit), z AS (SELECT unit, t, (v - m) / s AS z FROM spikes JOIN m USING (unit)),
 f AS (SELECT *, coalesce(z > 0.5, false) AS up, CASE WHEN coalesce(z > 0.5, false) = lag(coalesce(z > 0.5, false)) OVER (PARTITION BY unit ORDER BY t) THEN 0 ELSE 1 END AS fresh FROM z),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY unit ORDER BY t) AS run FROM f), a AS (SELECT unit, min(t) AS start, max(t) AS stop FROM g WHERE up GROUP BY unit, run),
 b AS (SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY unit ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM a),
 c AS (SELECT *, sum(fresh) OVER (PARTITION BY unit ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM b), d AS (SELECT unit, min(start) AS start, max(stop) AS stop FROM c GROUP BY unit, g),
 p AS (SELECT d.unit, start, stop, max(z) AS peak, arg_max(t, (z, -t)) AS peak_t FROM d JOIN z ON d.unit = z.unit AND t BETWEEN start AND stop GROUP BY 1, 2, 3)
 SELECT unit, start, stop, round(peak, 6) AS peak, peak_t FROM p WHERE peak > 1.5 AND stop - start BETWEEN 0 AND 172800000000""")
def o_evt_11_bursts(spark, sf):
    return ev.bursts(spikes(spark, sf).select("unit", "t", "v"), ["unit"], "t", "v", 0.5, 1.5, 6 * HOUR, 0, 48 * HOUR, DAY).select("unit", "start", "stop", R6("peak").alias("peak"), "peak_t")


@query("WITH {spikes} (SELECT id, t FROM spikes WHERE t > 1704500000000000 ORDER BY t LIMIT 1) UNION ALL (SELECT id, t FROM spikes WHERE t < 1704500000000000 ORDER BY t DESC LIMIT 1)")
def o_evt_13_neighbour_event(spark, sf):
    s = spikes(spark, sf).select("id", "t")
    return ev.neighbour_event(s, "t", 1704500000000000, "next").union(ev.neighbour_event(s, "t", 1704500000000000, "previous"))


ALIGNED = """a AS (SELECT k.ch, (k.t - e.t) AS lag, k.v FROM (SELECT ch, t // 60000000 AS t, v FROM spikes) k JOIN (SELECT t // 60000000 AS t FROM spikes WHERE ch = 'purchase') e ON k.t BETWEEN e.t - 20 AND e.t + 20),
 al AS (SELECT ch, lag, avg(v) AS mean, stddev_samp(v) AS deviation, count(*) AS n FROM a GROUP BY 1, 2)"""


def aligned(spark, sf):
    s = spikes(spark, sf).select("ch", F.floor(F.col("t") / 60_000_000).alias("t"), "v")
    e = s.filter("ch = 'purchase'").select("t")
    spans = e.select(F.col("t").alias("at"), (F.col("t") - 20).alias("start"), (F.col("t") + 20).alias("stop"))
    from ..operators.ordered import range_join

    hits = range_join(s, spans, [], "t", "start", "stop", 60)
    return hits.groupBy("ch", (F.col("t") - F.col("at")).alias("lag")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation"), F.count(F.lit(1)).alias("n"))


@query("WITH {spikes}, " + ALIGNED + " SELECT ch, lag, round(mean, 6) AS mean, round(deviation, 6) AS deviation, n FROM al")
def o_evt_14_event_aligned(spark, sf):
    return aligned(spark, sf).select("ch", "lag", R6("mean").alias("mean"), R6("deviation").alias("deviation"), "n")


@query("WITH {spikes}, " + ALIGNED + " SELECT ch, round(avg(deviation), 6) AS mean_deviation, round(max(mean) - min(mean), 6) AS span, coalesce(avg(deviation) > 19, false) OR coalesce(max(mean) - min(mean) > 60, false) AS bad FROM al GROUP BY ch")
def o_evt_14_bad_channels(spark, sf):
    return ev.bad_channels(aligned(spark, sf), "ch", 19.0, 60.0).select("ch", R6("mean_deviation").alias("mean_deviation"), R6("span").alias("span"), "bad")


# ---- unions and partitions

EPOCHS = "ep AS (SELECT l_orderkey AS epoch, count(*) AS n FROM lineitem GROUP BY 1)"


def epochs(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("epoch")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH {spikes}, a AS (SELECT row_number() OVER (ORDER BY t, id) - 1 AS s, v FROM spikes WHERE ch = 'click'), b AS (SELECT row_number() OVER (ORDER BY t, id) - 1 AS s, v FROM spikes WHERE ch = 'view') SELECT s, v, 0 AS epoch FROM a UNION ALL SELECT s + (SELECT count(*) FROM a), v, 1 FROM b")
def o_uni_01_concatenate(spark, sf):
    from ..operators.ordered import rank_of

    part = lambda c: rank_of(spikes(spark, sf).filter(F.col("ch") == c).select("t", "id", "v"), [], "t", ["id"], "s", DAY).select((F.col("s") - 1).alias("s"), "v")
    a, b = part("click"), part("view")
    return pt.concatenate([a, b], "s", [a.count(), 0])


@query("WITH " + EPOCHS + ", m AS (SELECT epoch, n, sum(n) OVER (ORDER BY epoch) AS stop_sample FROM ep) SELECT epoch, n, CAST(stop_sample AS BIGINT) AS stop_sample, CAST(stop_sample - n AS BIGINT) AS start_sample, (stop_sample - n) / 20.0 AS start_s, stop_sample / 20.0 AS stop_s FROM m")
def o_uni_02_mergepoints(spark, sf):
    return pt.mergepoints(epochs(spark, sf), [], "epoch", "n", 20.0, 500)


@query("WITH " + EPOCHS + """, g AS (SELECT epoch, unnest(range(n)) AS i FROM ep), s AS (SELECT l_orderkey AS epoch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i, CAST(l_quantity AS BIGINT) AS word FROM lineitem WHERE l_orderkey % 3 <> 0)
 SELECT epoch, i, coalesce(word, 0) AS word FROM g LEFT JOIN s USING (epoch, i)""")
def o_uni_03_zero_filled_epochs(spark, sf):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")) - 1
    side = table(spark, sf, "lineitem").filter("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("epoch"), i.cast("long").alias("i"), F.col("l_quantity").cast("long").alias("word"))
    return ev.zero_filled_epochs(epochs(spark, sf), side, ["epoch"], "n", "word")


@query("WITH " + EPOCHS + " SELECT epoch, unnest(range(n)) AS i FROM ep")
def o_uni_04_synthesize_index(spark, sf):
    return pt.synthesize_index(epochs(spark, sf), ["epoch"], "n")


@query("""WITH e AS (SELECT o_custkey AS session, o_orderkey AS epoch, o_orderdate AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders)
 SELECT session, epoch, number, printf('%03d_%s', number, CAST(session AS VARCHAR)) AS name FROM e""")
def o_uni_05_multi_session(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("epoch"), F.col("o_orderdate").alias("d"), F.lit(20000).alias("rate"), F.lit(64).alias("channels"))
    return pt.multi_session(e, "session", ["d", "epoch"], "rate", "channels").select("session", "epoch", "number", "name")


@query("WITH {spikes} SELECT unit, t FROM spikes WHERE ch = 'click' UNION ALL SELECT unit + (SELECT max(unit) FROM spikes WHERE ch = 'click'), t FROM spikes WHERE ch = 'view'")
def o_uni_06_append_units(spark, sf):
    s = spikes(spark, sf)
    return pt.append_units(s.filter("ch = 'click'").select("unit", "t", "v"), s.filter("ch = 'view'").select("unit", "t", "id"), "unit")


@query("SELECT c_custkey AS unit, c_acctbal AS rate, c_mktsegment AS kind, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier")
def o_uni_07_union_missing(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("rate"), F.col("c_mktsegment").alias("kind"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("rate"), F.col("s_name").alias("name"))
    return pt.union_missing([a, b])


@query("WITH {spikes} SELECT id, CASE WHEN ch IN ('click', 'view') THEN -v ELSE v END AS v FROM spikes")
def o_uni_08_transform_selected(spark, sf):
    return pt.transform_selected(spikes(spark, sf).select("id", "ch", "v"), F.col("ch").isin("click", "view"), "v", -F.col("v")).select("id", "v")


PARTED = "WITH " + CHANNELS_SQL + ", good AS (SELECT DISTINCT ch, probe, shank FROM channels WHERE connected AND ch % 10 <> 1) "


def excluded(spark, sf):
    return channels(spark, sf).filter("ch % 10 = 1").select("ch")


@query(PARTED + "SELECT 'probe' || probe AS name, probe, NULL::INT AS shank, list_sort(list(ch)) AS channels FROM good GROUP BY probe")
def o_uni_09_partitions_by_probe(spark, sf):
    return pt.sorter_partitions(channels(spark, sf), "probe", excluded(spark, sf))


@query(PARTED + "SELECT 'probe' || probe || '_shank' || shank AS name, probe, shank, list_sort(list(ch)) AS channels FROM good GROUP BY probe, shank")
def o_uni_10_partitions_by_shank(spark, sf):
    return pt.sorter_partitions(channels(spark, sf), "shank", excluded(spark, sf))


@query(PARTED + "SELECT DISTINCT ch FROM channels WHERE connected")
def o_uni_11_connected_channels(spark, sf):
    return channels(spark, sf).filter("connected").select("ch").dropDuplicates()


@query("WITH " + CHANNELS_SQL + ", f AS (SELECT probe, shank, row_number() OVER (ORDER BY min(ch)) - 1 AS group_id FROM channels GROUP BY 1, 2) SELECT ch, probe, shank, group_id FROM channels JOIN f USING (probe, shank)")
def o_uni_12_group_ids(spark, sf):
    return pt.group_ids(channels(spark, sf), "shank").select("ch", "probe", "shank", "group_id")


@query("WITH " + CHANNELS_SQL + " SELECT ch FROM channels WHERE NOT connected OR ch IN (SELECT l_suppkey + 5 FROM lineitem WHERE l_quantity >= 49)")
def o_uni_13_bad_channel_union(spark, sf):
    rejected = table(spark, sf, "lineitem").filter("l_quantity >= 49").select((F.col("l_suppkey") + 5).alias("ch"))
    return pt.bad_channel_union(rejected, channels(spark, sf))


@query("SELECT o_custkey, list_sort(list_distinct(list_concat(list(DISTINCT o_orderkey % 7), [CAST(2 AS BIGINT), 3]))) AS channels FROM orders GROUP BY o_custkey")
def o_uni_14_array_union(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 7).alias("c"))
    return o.select("o_custkey", F.array_sort(F.array_union("c", F.array(F.lit(2).cast("long"), F.lit(3).cast("long")))).alias("channels"))


@query("WITH " + CHANNELS_SQL + ", m AS (SELECT ch, CASE WHEN shank % 2 = 1 THEN shank - 1 ELSE shank END AS shank, x FROM channels) SELECT ch, shank, round(x - avg(x) OVER (PARTITION BY shank), 6) AS x FROM m")
def o_uni_15_recentre_pairs(spark, sf):
    pairs = table(spark, sf, "nation").filter("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("shank"), (F.col("n_nationkey") - 1).alias("into"))
    return pt.recentre_pairs(channels(spark, sf).select("ch", "shank", "x"), pairs).select("ch", "shank", R6("x").alias("x"))


# ---- filters

POLYGON = [(0.0, 0.0), (40.0, 10.0), (60.0, 300.0), (20.0, 150.0), (5.0, 320.0)]


def polygon_sql() -> str:
    inside, near = "false", "false"
    for (x0, y0), (x1, y1) in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True):
        inside = f"({inside} <> (({y0} > y) <> ({y1} > y) AND x < ({x1 - x0}) * (y - {y0}) / ({y1 - y0}) + {x0}))"
        dx, dy = x1 - x0, y1 - y0
        share = f"greatest(0.0, least(1.0, ((x - {x0}) * ({dx}) + (y - {y0}) * ({dy})) / {dx * dx + dy * dy}))"
        near += f" OR (x - ({x0} + {share} * ({dx}))) ** 2 + (y - ({y0} + {share} * ({dy}))) ** 2 <= 225.0"
    return f"WITH {CHANNELS_SQL} SELECT ch, {inside} AS inside, ({near}) AS near FROM channels"


@query(polygon_sql())
def o_flt_07_polygon(spark, sf):
    return channels(spark, sf).select("ch", fl.in_polygon(F.col("x"), F.col("y"), POLYGON).alias("inside"), fl.near_polyline(F.col("x"), F.col("y"), POLYGON, 15.0).alias("near"))


@query("WITH {spikes} SELECT id, t, v FROM spikes WHERE ch IN ('click', 'purchase')")
def o_flt_01_select_channels(spark, sf):
    return spikes(spark, sf).filter(F.col("ch").isin("click", "purchase")).select("id", "t", "v")


@query("WITH {spikes} SELECT id, CASE WHEN ch = 'error' THEN 0 ELSE v END AS v FROM spikes")
def o_flt_02_zero_channels(spark, sf):
    return fl.zero_where(spikes(spark, sf).select("id", "ch", "v"), F.col("ch") == "error", "v").select("id", "v")


@query("WITH {spikes} SELECT id, CASE WHEN v < 5 THEN NULL ELSE v END AS x, CASE WHEN v < 5 THEN NULL ELSE t END AS y FROM spikes")
def o_flt_05_likelihood(spark, sf):
    return fl.null_where(spikes(spark, sf).select("id", F.col("v").alias("x"), F.col("t").alias("y"), "v"), F.col("v") < 5, ["x", "y"]).select("id", "x", "y")


@query("WITH {spikes} SELECT id, unit FROM spikes WHERE unit NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def o_flt_09_without_groups(spark, sf):
    return fl.without_groups(spikes(spark, sf).select("id", "unit"), table(spark, sf, "labels").withColumnRenamed("doc_id", "unit"), "unit", "quality", [0])


@query("SELECT c_custkey AS unit FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name LIKE '%7%' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def o_flt_10_metric_filter(spark, sf):
    tagged = table(spark, sf, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("unit"))
    return fl.metric_filter(table(spark, sf, "customer").withColumnRenamed("c_custkey", "unit"), {"c_mktsegment": "BUILDING"}, {"c_name": "7"}, {"tags": tagged}).select("unit")


@query("WITH {spikes} SELECT id, t FROM spikes WHERE t >= 1704500000000000 AND t < 1705500000000000")
def o_flt_11_valid_times(spark, sf):
    return fl.valid_times(spikes(spark, sf), "t", 1704500000000000, 1705500000000000).select("id", "t")


@query("WITH {spikes} SELECT id, CASE WHEN max(abs(v)) OVER (PARTITION BY unit, t // 86400000000) >= 60 THEN 0 ELSE v END AS v FROM spikes")
def o_flt_12_blank_batches(spark, sf):
    return fl.blank_batches(spikes(spark, sf).select("unit", "t", "id", "v"), F.floor(F.col("t") / DAY), "v", 60.0, ["unit"]).select("id", "v")


@query("WITH " + SPANS + " SELECT id, EXISTS (SELECT 1 FROM spans s WHERE s.unit = k.unit AND k.t BETWEEN s.start AND s.stop) AS inside FROM spikes k")
def o_flt_13_restrict_exclude(spark, sf):
    s, sp = spikes(spark, sf).select("id", "unit", "t"), spans(spark, sf).select("unit", "start", "stop")
    keep = lambda f, b: f(s, sp, ["unit"], "t", HOUR).select("id", F.lit(b).alias("inside"))
    return keep(fl.restrict, True).union(keep(fl.exclude, False))


@query("WITH {spikes}, r AS (SELECT unit, id, row_number() OVER (PARTITION BY unit ORDER BY md5(CAST(id AS VARCHAR)), id) AS r FROM spikes WHERE ch <> 'error') SELECT unit, id FROM r WHERE r = 1")
def o_flt_14_random_good_unit(spark, sf):
    from ..operators.stats import position_in_key

    s = spikes(spark, sf).filter("ch <> 'error'").select("unit", "id", F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    return position_in_key(s, ["unit"], [F.col("h"), F.col("id")], 1).select("unit", "id")


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '1.*9') OR regexp_matches(c_mktsegment, '1.*9')")
def o_flt_15_text_filter(spark, sf):
    return fl.text_filter(table(spark, sf, "customer"), ["c_name", "c_mktsegment"], "1.*9").select("c_custkey", "c_name")


@query("WITH {spikes}, p AS (SELECT unit, t // 60000000 AS start, t // 60000000 + 30 AS stop FROM spikes WHERE ch = 'error') SELECT unit, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS minutes FROM p GROUP BY unit")
def o_int_12_exclusion_from_pulses(spark, sf):
    p = iv.windows_around(spikes(spark, sf).filter("ch = 'error'").select("unit", F.floor(F.col("t") / 60_000_000).alias("m")), "m", 0, 30)
    return p.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("minutes"))


@query("WITH {spikes}, e AS (SELECT unit, t // 864000000000 AS epoch, median(v) AS base FROM spikes GROUP BY 1, 2) SELECT id, round(v - base, 6) AS v FROM spikes s JOIN e ON s.unit = e.unit AND s.t // 864000000000 = e.epoch")
def o_int_14_epoch_baseline(spark, sf):
    s = spikes(spark, sf).withColumn("epoch", F.floor(F.col("t") / (10 * DAY)))
    base = s.groupBy("unit", "epoch").agg(F.median("v").alias("base"))
    return s.join(base, ["unit", "epoch"]).select("id", R6(F.col("v") - F.col("base")).alias("v"))
