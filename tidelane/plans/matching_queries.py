"""Queries of template matching and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as mt
from ..operators import units as un
from ..operators import waveforms as wv
from ..session import table
from .registry import query, spikes
from .signal_queries import BASE, HOURS, contacts, hourly, with_hours
from .sorting_queries import KEPT, WAVES, coordinates, waves
from .stat_queries import R6
from .unit_queries import BIN, BINS, CCG, CENTRES, FAR, METRICS, NEAR, SIMILAR, templates, trains


SHIFTED = """, tm AS (SELECT unit, ch, lag + 4 AS lag, mean AS value FROM wf WHERE mean IS NOT NULL), pr AS (SELECT a.unit, b.unit AS other FROM (SELECT DISTINCT unit FROM tm) a JOIN (SELECT DISTINCT unit FROM tm) b ON b.unit = a.unit + 1),
 nm AS (SELECT unit, sqrt(sum(value * value)) AS n FROM tm GROUP BY 1), sc AS (SELECT pr.unit, pr.other, d AS shift, sum(a.value * b.value) AS s FROM pr, range(-3, 4) r(d) JOIN tm a ON a.unit = pr.unit JOIN tm b ON b.unit = pr.other AND b.ch = a.ch AND b.lag = a.lag + d GROUP BY 1, 2, 3),
 sh AS (SELECT unit, other, arg_max(shift, (round(s, 9), -abs(shift), -shift)) AS shift, max(s) AS s FROM sc GROUP BY 1, 2)"""


def shifted(spark, sf):
    t = waves(spark, sf).filter("mean IS NOT NULL").select("unit", "ch", (F.col("lag") + 4).alias("lag"), F.col("mean").alias("value"))
    units = t.select("unit").distinct()
    pairs = units.join(units.select(F.col("unit").alias("other"), (F.col("unit") - 1).alias("unit")), "unit")
    return t, pairs, mt.template_shifts(t, pairs, 3)


@query("WITH {spikes}, " + HOURS + ", " + WAVES + SHIFTED + " SELECT unit, other, CAST(shift AS INT) AS shift, round(s / ((n.n + 1e-6) * (m.n + 1e-6)), 6) AS similarity FROM sh JOIN nm n USING (unit) JOIN nm m ON m.unit = other")
def o_srt_15_template_shifts(spark, sf):
    return shifted(spark, sf)[2].withColumn("similarity", R6("similarity"))


@query("WITH {spikes}, " + HOURS + ", " + WAVES + SHIFTED + """, mg AS (SELECT unit, other, shift FROM sh WHERE unit % 2 = 0), k AS (SELECT unit, count(*) AS k FROM spikes GROUP BY 1), g AS (SELECT k.unit, k.k, coalesce(mg.unit, k.unit) AS g, coalesce(shift, 0) AS d FROM k LEFT JOIN mg ON mg.other = k.unit)
 SELECT g AS unit, ch, lag - d AS lag, round(sum(value * k) / any_value(t), 6) AS value FROM tm JOIN g USING (unit) JOIN (SELECT g, sum(k) AS t FROM g GROUP BY 1) USING (g) GROUP BY 1, 2, 3""")
def o_srt_15_merged_templates(spark, sf):
    t, pairs, shifts = shifted(spark, sf)
    even = F.col("unit") % 2 == 0  # neighbours two by two, as merge decisions
    return mt.merged_templates(t, spikes(spark, sf), pairs.filter(even), shifts.filter(even)).withColumn("value", R6("value"))


@query()
def o_srt_14_matching_pursuit(spark, sf):
    t = waves(spark, sf).select("unit", "ch", (F.col("lag") + 4).alias("lag"), F.col("mean").alias("value"))
    return mt.matched(hourly(spark, sf), t, "s", "v", ["click", "error", "purchase", "view"], 11, 120.0, 256, 3)


@query()
def o_srt_11_seeds(spark, sf):
    v = coordinates(spark, sf)
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(mt.seeds(v, "vec_id", "x", 8))], "place int, vec_id long")


@query()
def o_ccg_07_fit_acg(spark, sf):
    acg = un.correlogram(trains(spark, sf), trains(spark, sf), "t", BIN, BINS).filter("unit = other")
    return mt.fit_acg(acg, ["unit"], 1.0).select("unit", F.round("tau_decay", 3).alias("tau_decay"), F.round("tau_rise", 3).alias("tau_rise"), F.round("r2", 3).alias("r2"))


@query("WITH {spikes}, " + CCG + METRICS + ", " + SIMILAR + " SELECT unit, other, round(similarity, 4) AS similarity, round(r, 6) AS r, round(q, 4) AS q FROM sim JOIN met USING (unit, other) WHERE r < 0.5 AND q < 0.5")
def o_srt_15_merge_candidates(spark, sf):
    return mt.merge_candidates(trains(spark, sf), templates(spark, sf), "t", "wave", -1.0, BIN, BINS, FAR, NEAR, CENTRES, 0.5, 0.5).select("unit", "other", F.round("similarity", 4).alias("similarity"), R6("r").alias("r"), F.round("q", 4).alias("q"))


@query("WITH {spikes}, " + HOURS + ", pk AS (SELECT DISTINCT t // 3600000000 - " + BASE + " AS p, id FROM spikes WHERE ch = 'purchase'), m AS (SELECT ch, avg(v) AS mean FROM sm JOIN pk ON s BETWEEN p - 2 AND p + 2 GROUP BY ch), c AS (SELECT m.*, CASE ch WHEN 'click' THEN 0.0 WHEN 'error' THEN 20.0 WHEN 'purchase' THEN 40.0 WHEN 'view' THEN 60.0 ELSE 80.0 END AS y FROM m) SELECT ch, y::DOUBLE AS y, round(mean, 6) AS mean, sign(mean) <> sign(first_value(mean) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS deep FROM c")
def o_wv_06_depth_profile(spark, sf):
    e = with_hours(spark, sf).filter("ch = 'purchase'").select(F.col("hour").alias("peak"))
    c = contacts(spark, sf).withColumn("shank", F.lit(0))
    return mt.depth_profile(hourly(spark, sf), e, c, "s", "v", 2).select("ch", "y", R6("mean").alias("mean"), "deep")


@query("WITH {spikes}, p AS (SELECT unit, ch, max(v) AS a FROM spikes GROUP BY 1, 2), c AS (SELECT *, CASE ch WHEN 'click' THEN 0.0 WHEN 'error' THEN 20.0 WHEN 'purchase' THEN 40.0 WHEN 'view' THEN 60.0 ELSE 80.0 END AS y, row_number() OVER (PARTITION BY unit ORDER BY a DESC, ch) AS r FROM p) SELECT unit, 0.0::DOUBLE AS x, round(sum(a * a * y) / sum(a * a), 6) AS y FROM c WHERE r <= 3 GROUP BY unit")
def o_wv_03_weighted_centre(spark, sf):
    p = spikes(spark, sf).groupBy("unit", "ch").agg(F.max("v").alias("a"))
    return mt.weighted_centre(p, contacts(spark, sf), "unit", "a", 3).select("unit", R6("x").alias("x"), R6("y").alias("y"))


@query("SELECT o_orderpriority AS kind, count(*) AS n, count(DISTINCT o_custkey) AS units, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ROLLUP (o_orderpriority)")
def o_ps_04_manipulation_summary(spark, sf):
    o = table(spark, sf, "orders")
    return o.rollup(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("units"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query()
def o_wv_03_trilaterate(spark, sf):
    p = spikes(spark, sf).groupBy("unit", "ch").agg(F.max("v").alias("a"))
    return mt.trilaterate(p, contacts(spark, sf), "unit", "a", 16)


@query()
def o_srt_25_bimodal_split(spark, sf):
    return wv.bimodal_split(coordinates(spark, sf), "vec_id", "unit", "x", KEPT, least=20)
