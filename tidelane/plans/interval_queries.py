"""Queries of the interval operators: views are spans of value minutes, errors and clicks are points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from .registry import DAY, HOUR, query, spikes

SPANS = """{spikes}, spans AS (SELECT unit, id, t AS start, t + CAST(floor(v * 60000000) AS BIGINT) AS stop FROM spikes WHERE ch = 'view'),
 cuts AS (SELECT unit, id AS cut_id, t AS start, t + CAST(floor(v * 30000000) AS BIGINT) AS stop FROM spikes WHERE ch = 'error')"""

#: Spans of `source` joined while the gap to the latest stop so far is at most `gap`.
MERGED = """, {out}_f AS (SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY unit ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS fresh FROM {source}),
 {out}_g AS (SELECT *, sum(fresh) OVER (PARTITION BY unit ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM {out}_f),
 {out} AS (SELECT unit, min(start) AS start, max(stop) AS stop, count(*) AS n FROM {out}_g GROUP BY unit, g)"""


def merged(source: str, gap: int, out: str) -> str:
    return MERGED.replace("{source}", source).replace("{gap}", str(gap)).replace("{out}", out)


#: What is left of spans outside cuts, by a sweep over all bounds.
SUBTRACTED = SPANS + """,
 e AS (SELECT unit, start AS t, 1 AS da, 0 AS db FROM spans UNION ALL SELECT unit, stop, -1, 0 FROM spans UNION ALL SELECT unit, start, 0, 1 FROM cuts UNION ALL SELECT unit, stop, 0, -1 FROM cuts),
 s AS (SELECT unit, t, sum(da) AS da, sum(db) AS db FROM e GROUP BY unit, t),
 o AS (SELECT unit, t, sum(da) OVER w AS na, sum(db) OVER w AS nb, lead(t) OVER (PARTITION BY unit ORDER BY t) AS nt FROM s WINDOW w AS (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING)),
 parts AS (SELECT unit, t AS start, nt AS stop FROM o WHERE na > 0 AND nb = 0 AND nt IS NOT NULL)""" + merged("parts", 0, "left_over")


def spans(spark, sf):
    return spikes(spark, sf).filter("ch = 'view'").select("unit", "id", F.col("t").alias("start"), (F.col("t") + F.floor(F.col("v") * 60000000)).alias("stop"))


def cuts(spark, sf):
    return spikes(spark, sf).filter("ch = 'error'").select("unit", F.col("id").alias("cut_id"), F.col("t").alias("start"), (F.col("t") + F.floor(F.col("v") * 30000000)).alias("stop"))


def clicks(spark, sf):
    return spikes(spark, sf).filter("ch = 'click'").select("unit", "id", "t")


@query("WITH " + SPANS + " SELECT unit, id, t, EXISTS (SELECT 1 FROM spans s WHERE s.unit = k.unit AND k.t BETWEEN s.start AND s.stop) AS inside FROM spikes k WHERE ch = 'click'")
def o_int_01_in_intervals(spark, sf):
    return iv.in_intervals(clicks(spark, sf), spans(spark, sf), ["unit"], "t", DAY)


@query("WITH " + SPANS + " SELECT k.unit, k.id, k.t, s.span_id, s.start, s.stop, row_number() OVER (PARTITION BY k.unit, s.span_id ORDER BY k.t) AS rank FROM spikes k JOIN (SELECT unit, id AS span_id, start, stop FROM spans) s ON k.unit = s.unit AND k.t BETWEEN s.start AND s.stop WHERE ch = 'click'")
def o_int_02_numbered_membership(spark, sf):
    return iv.numbered_membership(clicks(spark, sf), spans(spark, sf).withColumnRenamed("id", "span_id"), ["unit"], "t", "span_id", HOUR)


@query("WITH " + SPANS + merged("spans", 6 * HOUR, "m") + f" SELECT unit, start, stop, n FROM m WHERE stop - start >= {HOUR}")
def o_int_03_merge_intervals(spark, sf):
    return iv.merge_intervals(spans(spark, sf), ["unit"], 6 * HOUR, HOUR, DAY)


@query("WITH " + SUBTRACTED + " SELECT unit, start, stop FROM left_over")
def o_int_04_subtract_intervals(spark, sf):
    return iv.subtract_intervals(spans(spark, sf), cuts(spark, sf), ["unit"], DAY)


@query("WITH " + SUBTRACTED + " SELECT s.unit, s.id, greatest(s.start, l.start) AS start, least(s.stop, l.stop) AS stop FROM spans s JOIN left_over l ON s.unit = l.unit AND greatest(s.start, l.start) < least(s.stop, l.stop)")
def o_int_05_subtract_keeping_source(spark, sf):
    a = spans(spark, sf)
    return iv.intersect_intervals(a, iv.subtract_intervals(a, cuts(spark, sf), ["unit"], DAY), ["unit"], DAY).select("unit", "id", "start", "stop")


@query("WITH " + SPANS + f""", w AS (SELECT unit, id, start, stop, CASE WHEN start - {2 * HOUR} <= max(stop) OVER (PARTITION BY unit ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {2 * HOUR} THEN 0 ELSE 1 END AS fresh FROM spans),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY unit ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS target FROM w)
 SELECT unit, id, start, stop, CAST(target AS BIGINT) AS target, min(start) OVER (PARTITION BY unit, target) AS target_start, max(stop) OVER (PARTITION BY unit, target) AS target_stop FROM g""")
def o_int_06_consolidate(spark, sf):
    return iv.consolidate(spans(spark, sf), ["unit"], 2 * HOUR, width=DAY)


@query("""WITH {spikes}, f AS (SELECT unit, t, v >= 20 AS high, CASE WHEN (v >= 20) IS NOT DISTINCT FROM lag(v >= 20) OVER w AND lag(t) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM spikes WINDOW w AS (PARTITION BY unit ORDER BY t)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY unit ORDER BY t) AS run FROM f)
 SELECT unit, high, min(t) AS start, max(t) AS stop, count(*) AS n FROM g WHERE high GROUP BY unit, run, high""")
def o_int_07_runs_of_mask(spark, sf):
    return iv.runs(spikes(spark, sf).select("unit", "t", (F.col("v") >= 20).alias("high")), ["unit"], "t", "high", DAY).filter("high")


@query("WITH " + SPANS + f""" SELECT unit, id, start, stop,
 EXISTS (SELECT 1 FROM cuts c WHERE c.unit = s.unit AND abs(c.start - s.stop) <= {HOUR}) AS next_to_b, EXISTS (SELECT 1 FROM cuts c WHERE c.unit = s.unit AND abs(c.stop - s.start) <= {HOUR}) AS after_b FROM spans s""")
def o_int_08_adjacent(spark, sf):
    return iv.adjacent(spans(spark, sf), cuts(spark, sf), ["unit"], HOUR, DAY)


@query("WITH {spikes} SELECT * FROM (SELECT unit, id, t AS start, (SELECT min(t) FROM spikes o WHERE o.unit = k.unit AND o.ch = 'error' AND o.t > k.t) AS stop FROM spikes k WHERE ch = 'click') WHERE stop IS NOT NULL")
def o_int_09_pair_on_off(spark, sf):
    off = spikes(spark, sf).filter("ch = 'error'").select("unit", "t")
    return iv.pair_on_off(clicks(spark, sf), off, ["unit"], "t", DAY)


@query("WITH " + SPANS + f""", f AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY unit ORDER BY start, stop) <= {12 * HOUR} THEN 0 ELSE 1 END AS fresh FROM spans),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY unit ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS p FROM f)
 SELECT unit, min(start) AS start, arg_max(stop, (start, stop)) AS stop, count(*) AS n_pulses FROM g GROUP BY unit, p""")
def o_int_10_periods(spark, sf):
    return iv.periods(spans(spark, sf), ["unit"], 12 * HOUR, DAY)


@query("WITH {spikes} SELECT unit, id, t, greatest(t - 1704070800000000, 0) AS start, t + 1000000 AS stop, t + 1000000 - greatest(t - 1704070800000000, 0) AS duration FROM spikes WHERE ch = 'click'")
def o_int_11_windows_around_peaks(spark, sf):
    return iv.windows_around(clicks(spark, sf), "t", 1704070800000000, 1000000)


@query("WITH " + SPANS + " SELECT s.unit, s.id, c.cut_id, s.start AS a_start, s.stop AS a_stop, c.start AS b_start, c.stop AS b_stop, greatest(s.start, c.start) AS start, least(s.stop, c.stop) AS stop FROM spans s JOIN cuts c ON s.unit = c.unit AND greatest(s.start, c.start) < least(s.stop, c.stop)")
def o_int_13_intersect_intervals(spark, sf):
    return iv.intersect_intervals(spans(spark, sf), cuts(spark, sf), ["unit"], HOUR)


@query("WITH " + SUBTRACTED + f" SELECT unit, start, stop FROM left_over WHERE stop - start >= {HOUR // 6}")
def o_int_15_episodes_cut_by_rem(spark, sf):
    return iv.split_by(spans(spark, sf), cuts(spark, sf), ["unit"], HOUR // 6, DAY)
