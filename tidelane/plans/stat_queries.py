"""Queries of the aggregates and robust statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as st
from ..session import table
from .registry import DAY, HOUR, query, spikes

R6 = lambda c: F.round(c, 6)


def rounded(vector: str, digits: int):
    """An array with each number rounded; what rounds to 0 keeps its sign, as in SQL, since arrays are compared by their text."""

    def one(x):
        r = F.round(x, digits)
        return F.when(r == 0, x * F.lit(0.0)).otherwise(r)

    return F.transform(vector, one).alias(vector)


#: The labels table as cluster labels of units.
LABELLED = "lab AS (SELECT doc_id AS unit, CASE WHEN quality = 1 THEN 'good' ELSE 'mua' END AS label FROM labels)"


def labelled(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("unit"), F.when(F.col("quality") == 1, "good").otherwise("mua").alias("label"))


@query("WITH {spikes}, " + LABELLED + """, tot AS (SELECT (max(t) - min(t)) / 86400000000.0 AS days FROM spikes), r AS (SELECT unit, count(*) AS n, count(*) / (SELECT days FROM tot) AS rate FROM spikes GROUP BY unit)
 SELECT unit, n, round(rate, 6) AS rate, CASE WHEN coalesce(rate <= 2.2, false) THEN 'noise' ELSE coalesce(label, 'unsorted') END AS label FROM r FULL JOIN lab USING (unit)""")
def o_agg_01_low_rate_units(spark, sf):
    days = (F.col("_last") - F.col("_first")) / 86400000000.0
    return st.low_rate_units(spikes(spark, sf), labelled(spark, sf), "unit", "t", days, 2.2).withColumn("rate", R6("rate"))


@query("WITH {spikes}, n AS (SELECT unit, count(*) AS n FROM spikes GROUP BY unit) SELECT count(*) AS n_units, CAST(sum(n) AS BIGINT) AS n_spikes, count(*) FILTER (n < 60) AS n_noise FROM n")
def o_agg_02_count_units(spark, sf):
    n = spikes(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_spikes"), F.count_if(F.col("n") < 60).alias("n_noise"))


@query("""WITH {spikes}, n AS (SELECT unit, count(*) AS n FROM spikes GROUP BY unit), s AS (SELECT sum(n) AS total, max(n) AS most, median(n) AS middle FROM n)
 SELECT unit, n, round(n / total, 6) AS share, most, round(middle, 6) AS middle FROM n, s""")
def o_agg_03_stage_stats(spark, sf):
    n = spikes(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    s = n.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.median("n").alias("middle"))
    return n.crossJoin(F.broadcast(s)).select("unit", "n", R6(F.col("n") / F.col("total")).alias("share"), "most", R6("middle").alias("middle"))  # s has one row


ROBUST = "WITH {spikes}, m AS (SELECT {key}, median(v) AS med FROM spikes GROUP BY {key}), d AS (SELECT {key}, median(abs(v - med)) AS mad, any_value(med) AS med FROM spikes JOIN m USING ({key}) GROUP BY {key})"


@query(ROBUST.replace("{key}", "ch") + " SELECT id, round(CASE WHEN mad > 0 THEN 0.6745 * (v - med) / mad ELSE 0 END, 6) AS z FROM spikes JOIN d USING (ch)")
def o_agg_04_robust_z(spark, sf):
    return st.robust_z(spikes(spark, sf), ["ch"], "v").select("id", R6("z").alias("z"))


@query(ROBUST.replace("{key}", "unit") + " SELECT id, round(CASE WHEN mad > 0 THEN 0.6745 * (v - med) / mad ELSE 0 END, 6) AS z FROM spikes JOIN d USING (unit)")
def o_agg_05_robust_z_by_unit(spark, sf):
    return st.robust_z(spikes(spark, sf), ["unit"], "v").select("id", R6("z").alias("z"))


@query("WITH {spikes}, e AS (SELECT unit, min(v) AS lo, max(v) AS hi FROM spikes GROUP BY unit) SELECT id, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM spikes JOIN e USING (unit)")
def o_agg_06_min_max(spark, sf):
    return st.min_max(spikes(spark, sf), ["unit"], "v", "scaled").select("id", R6("scaled").alias("scaled"))


@query("WITH {spikes}, s AS (SELECT t // 3600000000 AS hour, median(abs(v)) AS m FROM spikes GROUP BY 1) SELECT round(5 * 1.4826 * median(m), 6) AS threshold FROM s")
def o_agg_07_amplitude_threshold(spark, sf):
    s = spikes(spark, sf).groupBy(F.floor(F.col("t") / HOUR).alias("hour")).agg(F.median(F.abs("v")).alias("m"))
    return s.agg(R6(5 * 1.4826 * F.median("m")).alias("threshold"))


@query("""WITH {spikes}, e AS (SELECT ch, (min(v) + max(v)) / 2 AS mid, var_pop(v) AS var, count(*) AS n FROM spikes GROUP BY ch),
 w AS (SELECT ch, sum(w) AS w FROM (SELECT ch, v > mid AS up, var_pop(v) * count(*) AS w FROM spikes JOIN e USING (ch) GROUP BY 1, 2) GROUP BY ch)
 SELECT ch, round(CASE WHEN var > 0 THEN 1 - w / n / var ELSE 0 END, 6) AS effectiveness FROM e JOIN w USING (ch)""")
def o_agg_08_effectiveness(spark, sf):
    return st.effectiveness(spikes(spark, sf), ["ch"], "v").withColumn("effectiveness", R6("effectiveness"))


@query(ROBUST.replace("{key}", "unit") + " SELECT id, abs(v - med) <= 3 * greatest(mad, 1e-6) AS kept FROM spikes JOIN d USING (unit)")
def o_agg_09_mad_mask(spark, sf):
    return st.mad_mask(spikes(spark, sf), ["unit"], "v", 3.0).select("id", "kept")


@query("""WITH {spikes}, r AS (SELECT unit, v, row_number() OVER (PARTITION BY unit ORDER BY v) AS i FROM spikes), s AS (SELECT unit, sum(v) AS s, sum(v * i) AS si, count(*) AS n FROM r GROUP BY unit)
 SELECT unit, round(CASE WHEN s <> 0 THEN 1 - 2 * ((n + 1) * s - si) / s / (n + 1) ELSE 0 END, 6) AS gini FROM s""")
def o_agg_10_gini(spark, sf):
    return st.gini(spikes(spark, sf), ["unit"], "v").withColumn("gini", R6("gini"))


BINNED = """WITH {spikes}, ends AS (SELECT min(t) // 86400000000 AS a, max(t) // 86400000000 AS b FROM spikes), grid AS (SELECT unit, unnest(range(a, b + 1)) AS bin FROM (SELECT DISTINCT unit FROM spikes), ends),
 n AS (SELECT unit, t // 86400000000 AS bin, count(*) AS n FROM spikes GROUP BY 1, 2), bins AS (SELECT unit, bin, coalesce(n, 0) AS n FROM grid LEFT JOIN n USING (unit, bin))"""


def day_bins(spark, sf):
    s = spikes(spark, sf)
    a, b = s.agg(F.min("t"), F.max("t")).first()  # one row
    return st.binned_counts(s, ["unit"], "t", DAY, a // DAY, b // DAY)


@query(BINNED + " SELECT unit, bin, n FROM bins")
def o_agg_11_dense_bins(spark, sf):
    return day_bins(spark, sf)


@query(BINNED + ", d AS (SELECT *, abs(n - lag(n) OVER (PARTITION BY unit ORDER BY bin)) AS step FROM bins) SELECT unit, round(stddev_samp(n) / avg(n), 6) AS cv, round(median(step) / avg(n), 6) AS instability FROM d GROUP BY unit")
def o_agg_11_rate_stability(spark, sf):
    return st.rate_stability(day_bins(spark, sf), ["unit"]).select("unit", R6("cv").alias("cv"), R6("instability").alias("instability"))


@query("WITH {spikes} SELECT unit, count(*) AS n, round(CASE WHEN max(t) > min(t) THEN count(*) / ((max(t) - min(t)) / 3600000000.0) END, 6) AS rate FROM spikes GROUP BY unit")
def o_agg_12_firing_rate(spark, sf):
    return st.firing_rate(spikes(spark, sf), ["unit"], "t", HOUR * 1.0).withColumn("rate", R6("rate"))


@query("WITH {spikes} SELECT unit, ch, count(*) AS n, round(avg(v), 6) AS mean FROM spikes GROUP BY unit, ch")
def o_agg_13_cluster_average(spark, sf):
    return spikes(spark, sf).groupBy("unit", "ch").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("v")).alias("mean"))


@query("""WITH {spikes}, e AS (SELECT ch, min(v) AS lo, CASE WHEN max(v) > min(v) THEN (max(v) - min(v)) / 20 ELSE 1.0 / 20 END AS w FROM spikes GROUP BY ch), g AS (SELECT *, unnest(range(20)) AS bin FROM e),
 n AS (SELECT ch, CAST(least(floor((v - lo) / w), 19) AS BIGINT) AS bin, count(*) AS n FROM spikes JOIN e USING (ch) GROUP BY 1, 2)
 SELECT ch, bin, round(lo + (bin + 0.5) * w, 6) AS centre, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (ch, bin)""")
def o_agg_14_histogram(spark, sf):
    return st.histogram(spikes(spark, sf), ["ch"], "v", 20).withColumn("centre", R6("centre"))


@query("""WITH {spikes}, a AS (SELECT unit, v FROM spikes WHERE ch = 'click'), b AS (SELECT unit, v FROM spikes WHERE ch = 'view'), na AS (SELECT unit, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT unit, count(*) AS nb FROM b GROUP BY 1),
 s AS (SELECT unit, v, sum(da) AS da, sum(db) AS db FROM (SELECT unit, v, 1 AS da, 0 AS db FROM a UNION ALL SELECT unit, v, 0, 1 FROM b) GROUP BY 1, 2),
 c AS (SELECT unit, sum(da) OVER w AS ca, sum(db) OVER w AS cb FROM s WINDOW w AS (PARTITION BY unit ORDER BY v ROWS UNBOUNDED PRECEDING)),
 d AS (SELECT unit, max(abs(ca / na - cb / nb)) AS d, any_value(na) AS na, any_value(nb) AS nb FROM c JOIN na USING (unit) JOIN nb USING (unit) GROUP BY unit),
 x AS (SELECT unit, d, greatest((sqrt(na * nb / (na + nb)) + 0.12 + 0.11 / sqrt(na * nb / (na + nb))) * d, 1e-3) AS x FROM d)
 SELECT unit, round(d, 6) AS d, round(least(greatest(2 * list_sum(list_transform(range(1, 102), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * x * x))), 0), 1), 6) AS p FROM x""")
def o_agg_15_ks(spark, sf):
    s = spikes(spark, sf)
    return st.ks_statistic(s.filter("ch = 'click'"), s.filter("ch = 'view'"), ["unit"], "v").select("unit", R6("d").alias("d"), R6("p").alias("p"))


@query("WITH {spikes}, s AS (SELECT ch, v * 60 AS seconds FROM spikes) SELECT ch, round(least(greatest(round(quantile_cont(seconds, 0.99), 3), 0.05), 6000), 3) AS duration FROM s GROUP BY ch")
def o_agg_16_percentile_duration(spark, sf):
    s = spikes(spark, sf).select("ch", F.lit(0.0).alias("start"), (F.col("v") * 60).alias("stop"))
    return st.percentile_duration(s, ["ch"], 0.99, 0.05, 6000.0, 1.0).withColumn("duration", F.round("duration", 3))


@query("""WITH {spikes}, p AS (SELECT unit, t, t - lag(t) OVER (PARTITION BY unit ORDER BY t) AS isi FROM spikes),
 s AS (SELECT unit, count(*) AS n, count(*) FILTER (isi < 3600000000) AS violations, (max(t) - min(t)) / 3600000000.0 AS span FROM p GROUP BY unit)
 SELECT unit, n, violations, round(CASE WHEN span > 0 THEN least(greatest(violations * span / (2 * 1.0 * n * n), 0), 1) END, 6) AS contamination FROM s""")
def o_agg_17_contamination(spark, sf):
    return st.contamination(spikes(spark, sf), ["unit"], "t", HOUR, HOUR * 1.0, DAY).select("unit", "n", F.col("violations").cast("long").alias("violations"), R6("contamination").alias("contamination"))


@query("""WITH c AS (SELECT label, i, j, CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE) AS p FROM embeddings, range(8) a(i), range(8) b(j)) SELECT label, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(avg(p), 6) AS moment FROM c GROUP BY 1, 2, 3""")
def o_agg_18_covariance(spark, sf):
    return st.covariance(table(spark, sf, "embeddings"), ["label"], "embedding", 8).withColumn("moment", R6("moment"))


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def o_agg_19_distinct(spark, sf):
    return st.lag_free_distinct(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("WITH {spikes} SELECT * FROM (SELECT unit, id, v, row_number() OVER (PARTITION BY unit ORDER BY v DESC, id) AS rank FROM spikes) WHERE rank <= 3")
def o_win_18_top_k(spark, sf):
    return st.position_in_key(spikes(spark, sf).select("unit", "id", "v"), ["unit"], [F.desc("v"), F.col("id")], 3)
