"""Queries of the lookups over results, and of staging, labelling and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import results as rs
from ..operators import sequences as sq
from ..operators import support as su
from ..operators import units as un
from ..session import table
from .registry import CHANNELS_SQL, HOUR, channels, query, spikes
from .signal_queries import CONTACTS_SQL, contacts
from .stat_queries import R6, rounded


@query("""WITH {spikes}, l AS (SELECT unit, t FROM spikes WHERE ch = 'click' AND v > 40), s AS (SELECT t FROM spikes WHERE ch = 'view'), sp AS (SELECT unit, min(t) AS start, min(t) + 21600000000 AS stop FROM spikes GROUP BY unit)
 SELECT unit, t, false AS from_shared FROM l UNION ALL SELECT sp.unit, s.t, true FROM sp JOIN s ON s.t BETWEEN start AND stop WHERE sp.unit NOT IN (SELECT unit FROM l)""")
def o_src_20_local_or_global(spark, sf):
    s = spikes(spark, sf)
    spans = s.groupBy("unit").agg(F.min("t").alias("start"), (F.min("t") + 6 * HOUR).alias("stop"))
    return rs.local_or_global_events(s.filter("ch = 'click' AND v > 40"), s.filter("ch = 'view'"), spans, "unit", "t", 6 * HOUR)


@query("WITH " + CHANNELS_SQL + " SELECT ch, shank, probe, x, y FROM channels WHERE connected")
def o_uni_16_without_channels(spark, sf):
    c = channels(spark, sf)
    return rs.without_channels(c, c.filter("NOT connected").select("ch")).select("ch", "shank", "probe", "x", "y")


@query("WITH " + CHANNELS_SQL + ", m AS (SELECT max(shank) AS s FROM channels) SELECT ch, x, y FROM channels, m WHERE shank = s")
def o_uni_16_one_shank(spark, sf):
    c = channels(spark, sf)
    return rs.one_shank(c.crossJoin(F.broadcast(c.agg(F.max("shank").alias("_s")))), "shank", F.col("_s")).select("ch", "x", "y")  # one row


@query("WITH " + CHANNELS_SQL + ", o AS (SELECT ch, x, y, shank, probe, dense_rank() OVER (ORDER BY probe) - 1 AS group_probe, dense_rank() OVER (ORDER BY probe, shank) - 1 AS group_shank FROM channels WHERE connected AND probe > 0) SELECT c.ch, o.x, o.y, o.shank, o.probe, group_probe, group_shank FROM channels c LEFT JOIN o USING (ch)")
def o_sig_03_attach_contacts(spark, sf):
    c = channels(spark, sf)
    other = c.filter("connected").select((F.col("ch") + 1_000_000).alias("ch"), "shank", "probe", "x", "y")  # outside of the recording
    return rs.attach_contacts(c.select("ch"), c.filter("connected").select("ch", "shank", "probe", "x", "y").union(other))


@query("WITH " + CHANNELS_SQL + """, g AS (SELECT r_regionkey AS centre, r_regionkey * 10.0 AS x, r_regionkey * 40.0 AS y FROM region), d AS (SELECT centre, ch, row_number() OVER (PARTITION BY centre ORDER BY (g.x - c.x) ** 2 + (g.y - c.y) ** 2, ch) AS r FROM g, channels c)
 SELECT centre, list(ch ORDER BY r) AS channels FROM d WHERE r <= 6 GROUP BY centre""")
def o_sup_04_template_channels(spark, sf):
    g = table(spark, sf, "region").select(F.col("r_regionkey").alias("centre"), (F.col("r_regionkey") * 10.0).alias("x"), (F.col("r_regionkey") * 40.0).alias("y"))
    return rs.nearest_channels(g, channels(spark, sf), 6)


PEAKS = "pk AS (SELECT unit, ch, max(v) - min(v) AS ptp FROM spikes GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ptp DESC, ch) AS r FROM pk), be AS (SELECT unit, ct.y FROM rk JOIN ct USING (ch) WHERE r = 1)"


def peaks(spark, sf):
    """unit, ch, ptp, name with channels as numbers, those without a number of their own last; ties go by name."""
    names = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "view")])
    number = lambda c: F.coalesce(F.nullif(F.array_position(names, c), F.lit(0)), F.lit(5))
    p = spikes(spark, sf).groupBy("unit", "ch").agg((F.max("v") - F.min("v")).alias("ptp"))
    return p.withColumn("name", F.col("ch")).withColumn("ch", number(F.col("ch"))), contacts(spark, sf).withColumn("ch", number(F.col("ch")))


NUMBER = "coalesce(nullif(list_position(['click', 'error', 'purchase', 'view'], {c}), 0), 5)"


@query("WITH {spikes}, " + CONTACTS_SQL + ", " + PEAKS + f" SELECT unit, CAST({NUMBER.format(c='ch')} AS BIGINT) AS ch FROM rk WHERE r <= 2")
def o_sup_20_best_channels(spark, sf):
    p, c = peaks(spark, sf)
    return rs.sparse_channels(p, c, "best_channels", 2, "name")


@query("WITH {spikes}, " + CONTACTS_SQL + ", " + PEAKS + f" SELECT unit, CAST({NUMBER.format(c='ct.ch')} AS BIGINT) AS ch FROM be JOIN ct ON abs(ct.y - be.y) <= 25")
def o_sup_20_radius(spark, sf):
    p, c = peaks(spark, sf)
    return rs.sparse_channels(p, c, "radius", 25.0, "name")


@query("WITH {spikes}, " + CONTACTS_SQL + ", " + PEAKS + f" SELECT unit, CAST(ch AS BIGINT) AS ch FROM (SELECT unit, {NUMBER.format(c='ct.ch')} AS ch, row_number() OVER (PARTITION BY unit ORDER BY abs(ct.y - be.y), {NUMBER.format(c='ct.ch')}) AS r FROM be, ct) WHERE r <= 3")
def o_sup_20_closest_channels(spark, sf):
    p, c = peaks(spark, sf)
    return rs.sparse_channels(p, c, "closest_channels", 3, "name")


@query("WITH {spikes}, m AS (SELECT arg_max(unit, (n, unit)) AS unit FROM (SELECT unit, count(*) AS n FROM spikes GROUP BY unit)) SELECT id, t FROM spikes JOIN m USING (unit)")
def o_sup_10_cluster_spikes(spark, sf):
    s = spikes(spark, sf)
    n = s.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("unit", F.struct("n", "unit")).alias("_u"))
    return rs.cluster_spikes(s.crossJoin(F.broadcast(n)), "unit", F.col("_u"), "t", "id").select("id", "t")  # n has one row


@query("WITH t AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) SELECT vec_id, list(round(m * CAST(embedding[1] AS DOUBLE), 6) ORDER BY i) AS wave FROM embeddings JOIN t USING (label) GROUP BY vec_id")
def o_sup_10_scaled_templates(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("amplitude"), "embedding")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    t = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("wave"))
    return rs.scaled_templates(e, t, "label", "vec_id", "amplitude", "wave").select("vec_id", rounded("wave", 6))


@query("SELECT count(*) AS files, CAST(sum(n_chars // 8) AS BIGINT) AS samples, bool_and(n_chars % 8 = 0) AS whole FROM documents")
def o_sup_11_total_samples(spark, sf):
    return rs.total_samples(table(spark, sf, "documents").select(F.col("source").alias("path"), F.col("n_chars").alias("length")), 4)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS name, CAST(o_totalprice AS DOUBLE) AS start, o_totalprice + 10.0 AS stop FROM orders")
def o_sup_12_session_epochs(spark, sf):
    return rs.session_epochs(table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_totalprice").alias("start"), (F.col("o_totalprice") + 10.0).alias("stop")), "session")


@query("WITH {spikes} SELECT id, v FROM spikes WHERE v BETWEEN 1 AND 60")
def o_sup_18_finite_only(spark, sf):
    s = spikes(spark, sf).withColumn("v", F.when(F.col("v") < 1, F.lit(float("nan"))).when(F.col("v") > 60, F.lit(float("inf"))).otherwise(F.col("v")))
    return rs.finite_only(s, "v").select("id", "v")


@query("SELECT i * 1000 AS first, CAST(least(1000, 4321 - i * 1000) AS INT) AS n, CAST(least(1000, 4321 - i * 1000) * 2 * 3 AS INT) AS bytes FROM range(5) r(i)")
def o_sup_19_zero_frames(spark, sf):
    return rs.zero_frames(spark, 4321, 3, 1000).select("first", "n", F.octet_length("data").alias("bytes"))


LABELS = "lb AS (SELECT doc_id AS unit, CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'noise' END AS label FROM labels), mt AS (SELECT unit, count(*) AS n, stddev_samp(v) AS sd FROM spikes GROUP BY unit)"


def stored_labels(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("unit"), F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "noise").alias("label"))


@query("WITH {spikes}, " + LABELS + " SELECT unit, CASE WHEN coalesce(n < 60 OR sd < 15, false) THEN 'noise' WHEN label = 'noise' THEN 'unsorted' ELSE coalesce(label, 'unsorted') END AS label FROM lb LEFT JOIN mt USING (unit)")
def o_sup_21_relabelled(spark, sf):
    m = spikes(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"))
    return rs.relabelled(stored_labels(spark, sf), m, (F.col("n") < 60) | (F.col("sd") < 15))


@query("WITH {spikes}, " + LABELS + " SELECT (SELECT count(DISTINCT unit) FROM spikes) AS n_units_initial, (SELECT count(*) FROM spikes) AS n_spikes_initial, (SELECT count(DISTINCT unit) FROM spikes WHERE v > 50) AS n_units_final, (SELECT count(*) FROM spikes WHERE v > 50) AS n_spikes_final, (SELECT count(*) FROM lb WHERE label = 'noise') AS n_noise")
def o_sup_21_summary(spark, sf):
    s = spikes(spark, sf)
    return rs.output_summary(s, s.filter("v > 50"), stored_labels(spark, sf))


SAFE = "regexp_replace(regexp_replace({x}, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"WITH a AS (SELECT c_nationkey, arg_min(c_name, c_custkey) AS a, arg_max(c_name, c_custkey) AS b, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey, 'multiday_' || {SAFE.format(x='a')} || CASE WHEN n > 1 THEN '_to_' || {SAFE.format(x='b')} ELSE '' END AS name FROM a")
def o_sup_22_multi_day_names(spark, sf):
    return rs.multi_day_names(table(spark, sf, "customer"), ["c_nationkey"], "c_custkey", "c_name")


@query("WITH p AS (SELECT c_nationkey, '/data/' || c_mktsegment || '/' || c_custkey AS p FROM customer), a AS (SELECT c_nationkey, count(DISTINCT p) AS n, count(DISTINCT string_split(p, '/')[3]) AS k, min(p) AS p FROM p GROUP BY 1) SELECT c_nationkey, CASE WHEN k > 1 THEN '/data' ELSE '/data/' || string_split(p, '/')[3] END AS parent FROM a")
def o_sup_22_common_parent(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string")).alias("path"))
    return rs.common_parent(c, ["c_nationkey"], "path")


@query("SELECT s_name AS path, CASE WHEN s_acctbal > 0 THEN 'stream' ELSE 'raw' END AS source, CAST(CASE WHEN s_acctbal > 0 THEN s_nationkey + 1 ELSE 64 END AS INT) AS n_channels, CASE WHEN s_acctbal > 0 THEN 30000.0 ELSE 20000.0 END::DOUBLE AS rate FROM supplier")
def o_sup_22_source_info(spark, sf):
    own = F.col("s_acctbal") > 0
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("path"), F.when(own, F.col("s_nationkey") + 1).alias("stream_channels"), F.when(own, F.lit(30000.0)).alias("stream_rate"))
    return rs.check_sources(rs.source_info(s, 64, 20000.0), ["path"])


@query("SELECT source AS label, list_sort(list_distinct(list(doc_id))) AS units FROM (SELECT doc_id, unnest([source, lang]) AS source FROM documents) WHERE source IS NOT NULL GROUP BY 1")
def o_sup_25_membership(spark, sf):
    return rs.membership(table(spark, sf, "documents").select("doc_id", F.filter(F.array("source", "lang"), lambda x: x.isNotNull()).alias("tags")), "doc_id", "tags")


@query("SELECT c_custkey, round(CAST(c_acctbal AS DOUBLE), 6) AS c_acctbal, c_mktsegment FROM customer")
def o_sup_26_metrics_table(spark, sf):
    c = rs.check_metrics(table(spark, sf, "customer"), {"c_custkey": "int", "c_name": "string"})
    return rs.metrics_table(c, "c_custkey", ["c_acctbal", "absent", "c_mktsegment", "c_custkey"])


@query("WITH " + CHANNELS_SQL + " SELECT DISTINCT ch FROM channels WHERE NOT connected OR probe = 2")
def o_sup_27_tagged_channels(spark, sf):
    c = channels(spark, sf)
    own = c.filter("NOT connected").select(F.lit("Bad").alias("tag"), F.array("ch").alias("channels"), F.lit(None).cast("array<int>").alias("groups"))
    group = c.select("probe").distinct().filter("probe = 2").select(F.lit("Bad"), F.lit(None).cast("array<long>"), F.array(F.col("probe").cast("int")))
    other = c.select("probe").distinct().select(F.lit("Other"), F.lit(None).cast("array<long>"), F.array(F.col("probe").cast("int")))
    return rs.tagged_channels(own.union(group).union(other), c.select(F.col("probe").cast("int").alias("group"), "ch"), "Bad")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS u, s_nationkey + 100000 AS v FROM supplier WHERE s_acctbal >= 5000), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS node, u AS g FROM b UNION SELECT b.v, r.g FROM r JOIN b ON r.node = b.u), m AS (SELECT node, min(g) AS g FROM r GROUP BY node)
 SELECT s_suppkey AS unit, coalesce(g, s_suppkey) AS merged FROM supplier LEFT JOIN m ON node = s_suppkey""")
def o_sup_29_all_merges(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("unit"), (F.col("s_nationkey") + 100000).cast("long").alias("other"), F.col("s_acctbal").alias("score"))
    return rs.all_merges(s, s, "score", 5000.0)


@query("WITH {spikes} SELECT id, CASE WHEN v < 5 THEN 'small' END AS reason FROM spikes")
def o_sup_30_split_spikes(spark, sf):
    kept, gone = rs.split_spikes(spikes(spark, sf), F.col("v") < 5, "small")
    return kept.select("id", F.lit(None).cast("string").alias("reason")).union(gone.select("id", "reason"))


@query("""WITH f AS (SELECT '/s/' || CASE WHEN s_suppkey % 4 = 0 THEN 'other' ELSE 'rec' END || '.' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN '.events.mat' WHEN s_suppkey % 3 = 1 THEN '.states.mat' ELSE '.txt' END AS path, s_nationkey, s_suppkey FROM supplier)
 SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'events' ELSE 'states' END AS kind, CAST(s_nationkey AS VARCHAR) AS name, path FROM f WHERE s_suppkey % 4 <> 0 AND s_suppkey % 3 < 2""")
def o_sup_31_containers(spark, sf):
    k = F.col("s_suppkey")
    path = F.concat(F.lit("/s/"), F.when(k % 4 == 0, "other").otherwise("rec"), F.lit("."), F.col("s_nationkey").cast("string"), F.when(k % 3 == 0, ".events.mat").when(k % 3 == 1, ".states.mat").otherwise(".txt"))
    return rs.containers(table(spark, sf, "supplier").select(path.alias("path")), "rec", {"events.mat": "events", "states.mat": "states"})


@query("WITH {spikes}, " + CONTACTS_SQL + ", p AS (SELECT unit, ch, sum(v * v) AS p FROM spikes GROUP BY 1, 2) SELECT unit, round(sum(p * y) / nullif(sum(p), 0), 6) AS depth FROM p JOIN ct USING (ch) GROUP BY unit")
def o_srt_22_unit_depth(spark, sf):
    return rs.unit_depth(spikes(spark, sf).select("unit", "ch", F.col("v").alias("mean")), contacts(spark, sf)).withColumn("depth", R6("depth"))


FACTORS = "fl AS (SELECT label AS unit, k AS rank, i AS lag, avg(CAST(embedding[k * 8 + i + 1] AS DOUBLE)) AS w FROM embeddings, range(3) a(k), range(8) b(i) GROUP BY 1, 2, 3), fr AS (SELECT label AS unit, k AS rank, c AS ch, avg(CAST(embedding[40 + k * 4 + c + 1] AS DOUBLE)) AS u FROM embeddings, range(3) a(k), range(4) b(c) GROUP BY 1, 2, 3)"


@query("WITH " + FACTORS + " SELECT unit, lag, ch, round(sum(w * u), 6) AS value FROM fl JOIN fr USING (unit, rank) GROUP BY 1, 2, 3")
def o_snk_07_factored_templates(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("unit"), F.posexplode("embedding").alias("p", "x")).groupBy("unit", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    p = F.col("p").cast("long")
    left = e.filter("p < 24").select("unit", F.floor(p / 8).alias("rank"), (p % 8).alias("lag"), F.col("m").alias("w"))
    right = e.filter("p BETWEEN 40 AND 51").select("unit", F.floor((p - 40) / 4).alias("rank"), ((p - 40) % 4).alias("ch"), F.col("m").alias("u"))
    return rs.factored_templates(left, right).withColumn("value", R6("value"))


@query("WITH {spikes} SELECT id, round(greatest(v - 2.0, 0), 6) AS start, round(v + 3.0, 6) AS stop, v AS peak, round(v + 3.0 - greatest(v - 2.0, 0), 6) AS duration FROM spikes")
def o_snk_04_event_table(spark, sf):
    s = spikes(spark, sf).select("id", "v")
    return rs.event_table(s, "v", 2.0, 3.0).join(s.select("id", F.col("v").alias("peak")), "peak").distinct().select("id", R6("start").alias("start"), R6("stop").alias("stop"), "peak", R6("duration").alias("duration"))


@query("WITH {spikes} SELECT 'digital' AS source, ch, min(t) AS \"on\", max(t) AS off FROM spikes WHERE ch IN ('click', 'error') GROUP BY ch UNION ALL SELECT 'analog', ch, min(t), max(t) FROM spikes WHERE v > 50 GROUP BY ch")
def o_evt_06_pulse_table(spark, sf):
    ends = lambda df: df.groupBy("ch").agg(F.min("t").alias("on"), F.max("t").alias("off"))
    s = spikes(spark, sf)
    return rs.pulse_table(s.filter("ch IN ('click', 'error')"), s, ends, lambda df: ends(df.filter("v > 50")))


EXPORT = """WITH RECURSIVE {spikes}, e AS (SELECT unit, t // 60000000 AS s, min(id) AS spike FROM spikes GROUP BY 1, 2), k AS (SELECT unit, min(s) AS s FROM e GROUP BY 1 UNION ALL SELECT k.unit, (SELECT min(e.s) FROM e WHERE e.unit = k.unit AND e.s >= k.s + 120) FROM k WHERE k.s IS NOT NULL),
 f AS (SELECT id AS spike, c, CASE WHEN c = 0 THEN v ELSE v * (id % 5) END AS w FROM spikes, range(2) r(c))
 SELECT e.spike, unit, s, round(sqrt(sum(w * w)), 6) AS amplitude, round(sum(w * w * c * 10.0) / nullif(sum(w * w), 0), 6) AS x, round(sum(w * w * c * 25.0) / nullif(sum(w * w), 0), 6) AS y FROM k JOIN e USING (unit, s) JOIN f USING (spike) GROUP BY 1, 2, 3"""


@query(EXPORT)
def o_snk_08_export(spark, sf):
    s = spikes(spark, sf).select(F.col("id").alias("spike"), "unit", F.floor(F.col("t") / 60_000_000).alias("s"), "v")
    f = s.withColumn("ch", F.explode(F.array(F.lit(0), F.lit(1)))).select("spike", "ch", F.when(F.col("ch") == 0, F.col("v")).otherwise(F.col("v") * (F.col("spike") % 5)).alias("w"))
    c = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 25.0)], "ch int, x double, y double")
    labels = spark.createDataFrame([], "unit long, label string")
    out = rs.export_tables(s.drop("v"), f, c, labels, f, 120)["spikes"]
    return out.select("spike", "unit", "s", *[R6(x).alias(x) for x in ("amplitude", "x", "y")])


@query("WITH {spikes} SELECT id, CASE WHEN v > 40 OR ch = 'error' THEN NULL ELSE v END AS v, CASE WHEN v > 40 OR ch = 'error' THEN NULL ELSE t END AS t FROM spikes")
def o_flt_06_clean_mask(spark, sf):
    return fl.null_where(spikes(spark, sf), (F.col("v") > 40) | (F.col("ch") == "error"), ["v", "t"]).select("id", "v", "t")


@query("WITH " + CHANNELS_SQL + " SELECT ch, sqrt(greatest(greatest(10 - x, x - 50), 0) ** 2 + greatest(greatest(20 - y, y - 200), 0) ** 2) BETWEEN 0.001 AND 25 OR (x BETWEEN 10 AND 50 AND y BETWEEN 20 AND 200 AND least(x - 10, 50 - x, y - 20, 200 - y) <= 25) AS near FROM channels")
def o_flt_08_near_polyline(spark, sf):
    box = [(10.0, 20.0), (50.0, 20.0), (50.0, 200.0), (10.0, 200.0)]
    return channels(spark, sf).select("ch", fl.near_polyline(F.col("x"), F.col("y"), box, 25.0).alias("near"))


@query("WITH {spikes}, i AS (SELECT unit, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b FROM spikes WINDOW w AS (PARTITION BY unit ORDER BY t, id)) SELECT unit, round(count(*) FILTER (a < 7200000000 AND b IS NOT NULL OR b < 7200000000 AND a IS NOT NULL) / nullif(count(*) - 1, 0), 6) AS burst_index FROM i GROUP BY unit")
def o_win_03_burst_index(spark, sf):
    return sq.spike_train_metrics(spikes(spark, sf), ["unit"], "t", 2 * HOUR, HOUR, 24 * HOUR, ("id",)).select("unit", R6("burst_index").alias("burst_index"))


@query("WITH {spikes}, i AS (SELECT unit, t - lag(t) OVER (PARTITION BY unit ORDER BY t, id) AS a FROM spikes) SELECT unit, round(1000.0 * count(*) FILTER (a < 3600000000) / count(*), 6) AS refractory_per_mille FROM i GROUP BY unit")
def o_win_04_refractory_violations(spark, sf):
    return sq.spike_train_metrics(spikes(spark, sf), ["unit"], "t", 2 * HOUR, HOUR, 24 * HOUR, ("id",)).select("unit", R6("refractory_per_mille").alias("refractory_per_mille"))


@query("""WITH {spikes}, g AS (SELECT unit, t // 604800000000 AS epoch, t, CASE WHEN v < 12 THEN NULL ELSE v END AS v FROM spikes), n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER lo AS t0, last_value(v IGNORE NULLS) OVER lo AS v0, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER hi AS t1, first_value(v IGNORE NULLS) OVER hi AS v1 FROM g
 WINDOW lo AS (PARTITION BY unit, epoch ORDER BY t ROWS UNBOUNDED PRECEDING), hi AS (PARTITION BY unit, epoch ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT unit, epoch, t, round(CASE WHEN v IS NOT NULL THEN v WHEN t1 - t0 <= 43200000000 THEN v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END, 6) AS v FROM n""")
def o_win_08_gaps_by_epoch(spark, sf):
    rows = spikes(spark, sf).select("unit", F.floor(F.col("t") / (168 * HOUR)).alias("epoch"), "t", F.when(F.col("v") >= 12, F.col("v")).alias("v"))
    return sq.fill_gaps(rows, ["unit", "epoch"], "t", "v", 12 * HOUR, 24 * HOUR).select("unit", "epoch", "t", R6("v").alias("v"))


@query("""WITH RECURSIVE {spikes}, e AS (SELECT DISTINCT unit, t FROM spikes), k AS (SELECT unit, min(t) AS t FROM e GROUP BY unit UNION ALL SELECT k.unit, (SELECT min(e.t) FROM e WHERE e.unit = k.unit AND e.t >= k.t + 10800000000) FROM k WHERE k.t IS NOT NULL) SELECT unit, t FROM k WHERE t IS NOT NULL""")
def o_win_16_censored(spark, sf):
    return sq.greedy_thin(spikes(spark, sf), ["unit"], "t", 3 * HOUR, 24 * HOUR)


@query("""WITH RECURSIVE t AS (SELECT n_nationkey + 100 AS parent, 2 * n_nationkey + 101 AS "left", 2 * n_nationkey + 102 AS "right" FROM nation), r AS (SELECT parent FROM t WHERE parent IN (103, 107) UNION SELECT t.parent FROM r JOIN t p ON p.parent = r.parent JOIN t ON t.parent IN (p."left", p."right")) SELECT parent, "left", "right" FROM t WHERE parent NOT IN (SELECT parent FROM r)""")
def o_sup_06_pruned_tree(spark, sf):
    n = F.col("n_nationkey")
    return su.pruned_tree(table(spark, sf, "nation").select((n + 100).alias("parent"), (2 * n + 101).alias("left"), (2 * n + 102).alias("right")), [103, 107])


@query("""WITH {spikes}, a AS (SELECT unit, t FROM spikes WHERE ch = 'view'), b AS (SELECT unit, t + 20000000 AS t FROM spikes WHERE ch = 'view' AND v > 10), h AS (SELECT a.unit, b.unit AS best, count(DISTINCT a.t) AS c FROM a JOIN b ON abs(a.t - b.t) <= 60000000 AND a.unit = b.unit GROUP BY 1, 2) SELECT unit, c AS n_matched FROM h""")
def o_srt_21_matched_spikes(spark, sf):
    s = spikes(spark, sf).filter("ch = 'view'")
    a, b = s.select("unit", "t"), s.filter("v > 10").select("unit", (F.col("t") + 20_000_000).alias("t"))
    met = un.close_pairs(a, b, ["unit"], "t", 60_000_001).filter(F.abs(F.col("b_t") - F.col("t")) <= 60_000_000)
    return met.groupBy("unit").agg(F.count_distinct("t").alias("n_matched"))
