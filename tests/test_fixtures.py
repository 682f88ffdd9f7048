"""Small inputs with results derived by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.functions import geometry, special, text
from tidelane.operators import events as ev
from tidelane.operators import filters as fl
from tidelane.operators import intervals as iv
from tidelane.operators import joins as jn
from tidelane.operators import partitions as pt
from tidelane.operators import sequences as sq
from tidelane.operators import signals as sg
from tidelane.operators import sorting as so
from tidelane.operators import states as ss
from tidelane.operators import stats as st
from tidelane.operators import support as su
from tidelane.operators import units as un
from tidelane.operators import waveforms as wv
from tidelane.operators.ordered import asof, nearest, previous, running
from tidelane.plans import config, plugins

WIDTHS = [None, 1, 3, 1000]


def spans(spark, rows):
    return spark.createDataFrame([("k", a, b) for a, b in rows], "key string, start long, stop long")


def pairs(df):
    return sorted((r.start, r.stop) for r in df.collect())


@pytest.mark.parametrize("width", WIDTHS)
def test_interval_algebra(spark, width):
    assert pairs(iv.merge_intervals(spans(spark, [(0, 10), (12, 20), (50, 60)]), ["key"], 5, 15, width)) == [(0, 20)]
    assert pairs(iv.subtract_intervals(spans(spark, [(0, 10)]), spans(spark, [(2, 3), (8, 12)]), ["key"], width)) == [(0, 2), (3, 8)]
    assert pairs(iv.periods(spans(spark, [(0, 1), (10, 11), (40, 41)]), ["key"], 20, width)) == [(0, 11), (40, 41)]
    mask = spark.createDataFrame([("k", 0, 1), ("k", 1, 1), ("k", 2, 0), ("k", 3, 1)], "key string, t long, m int")
    assert pairs(iv.runs(mask, ["key"], "t", "m", width).filter("m = 1")) == [(0, 1), (3, 3)]
    points = spark.createDataFrame([("k", t) for t in range(4)], "key string, t long")
    assert [r.inside for r in iv.in_intervals(points, spans(spark, [(1, 2)]), ["key"], "t", width).orderBy("t").collect()] == [False, True, True, False]
    on, off = (spark.createDataFrame([("k", t) for t in ts], "key string, t long") for ts in ([1, 3, 4, 6], [3, 5]))
    assert pairs(iv.pair_on_off(on, off, ["key"], "t", width)) == [(1, 3), (3, 5), (4, 5)]
    assert pairs(iv.merge_intervals(spans(spark, []), ["key"], 0, None, width)) == []


@pytest.mark.parametrize("width", WIDTHS)
def test_ordered_primitives_do_not_depend_on_the_width(spark, width):
    rng = np.random.default_rng(4)
    data = [(int(k), int(t), int(i), float(v) if v > 0.2 else None) for i, (k, t, v) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 60, 200), rng.random(200)))]
    df = spark.createDataFrame(data, "k int, t long, i long, v double")
    for how, fold in (("sum", lambda x: sum(x) if x else None), ("max", lambda x: max(x, default=None)), ("last", lambda x: x[-1] if x else None)):
        for inclusive in (True, False):
            got = {r.i: r.out for r in running(df, ["k"], "t", ["i"], {"out": F.col("v")}, how, width, inclusive).collect()}
            for k, t, i, v in data:
                before = [x[3] for x in sorted(data, key=lambda x: x[1:3]) if x[0] == k and x[3] is not None and ((x[1:3] <= (t, i)) if inclusive else (x[1:3] < (t, i)))]
                want = fold(before)
                assert got[i] == want or abs(got[i] - want) < 1e-9


@pytest.mark.parametrize("width", WIDTHS)
def test_joins_on_time(spark, width):
    samples = spark.createDataFrame([("k", 0, 1.0), ("k", 10, 2.0)], "key string, t long, v double")
    points = spark.createDataFrame([("k", t) for t in (-5, 5, 4, 10, 99)], "key string, t long")
    assert {r.t: r.v for r in nearest(points, samples, ["key"], "t", "v", width).collect()} == {-5: 1.0, 5: 2.0, 4: 1.0, 10: 2.0, 99: 2.0}
    assert {r.t: r.v for r in asof(points, samples, ["key"], "t", ["v"], width).collect()} == {-5: None, 5: 1.0, 4: 1.0, 10: 2.0, 99: 2.0}
    assert {r.t: r.v for r in asof(points, samples, ["key"], "t", ["v"], width, "forward", strict=True).collect()} == {-5: 1.0, 5: 2.0, 4: 2.0, 10: None, 99: None}
    assert {r.t: r.v for r in jn.interpolate_at(points, samples, ["key"], "t", "v", width).collect()} == {-5: None, 5: 1.5, 4: 1.4, 10: 2.0, 99: None}


@pytest.mark.parametrize("width", WIDTHS)
def test_sequences(spark, width):
    bits = spark.createDataFrame([("k", t, b) for t, b in enumerate([0, 0, 1, 1, 0, 1])], "key string, t long, b int")
    assert sorted((r.t, r.edge) for r in sq.edges(bits, ["key"], "t", "b", width).collect()) == [(1, 1), (3, -1), (4, 1)]
    events = spark.createDataFrame([("k", t) for t in (0, 4, 8)], "key string, t long")
    assert sorted(r.t for r in sq.greedy_thin(events, ["key"], "t", 5, width).collect()) == [0, 8]
    gaps = spark.createDataFrame([("k", 0, 0.0), ("k", 1, None), ("k", 2, None), ("k", 3, 3.0)], "key string, t long, v double")
    assert [r.v for r in sq.fill_gaps(gaps, ["key"], "t", "v", 3, width).orderBy("t").collect()] == [0, 1, 2, 3]
    assert [r.v for r in sq.fill_gaps(gaps, ["key"], "t", "v", 2.9, width).orderBy("t").collect()] == [0, None, None, 3]
    states = spark.createDataFrame([("k", t, s) for t, s in enumerate([1, 0, 0, 0, 3])], "key string, t long, s int")
    assert [r.s for r in sq.fill_states(states, ["key"], "t", "s", width).orderBy("t").collect()] == [1, 1, 1, 3, 3]
    track = spark.createDataFrame([("k", 0, 0.0, 0.0), ("k", 1, 3.0, 4.0), ("k", 2, 3.0, 4.0)], "key string, t long, x double, y double")
    assert [(r.speed, r.acceleration) for r in sq.speed(track, ["key"], "t", "x", "y", 1.0, width).orderBy("t").collect()] == [(0, 0), (5, 5), (0, -5)]
    spikes = spark.createDataFrame([("k", t) for t in (0, 5, 1000, 2000)], "key string, t long")
    assert abs(sq.spike_train_metrics(spikes, ["key"], "t", 6, 2, width).first().burst_index - 1 / 3) < 1e-12
    smooth = spark.createDataFrame([("k", 0, 1.0), ("k", 1, None), ("k", 2, 3.0)], "key string, t long, v double")
    assert [r.smooth for r in sq.centred_mean(smooth, ["key"], "t", "v", 3).orderBy("t").collect()] == [1, 2, 3]


def test_even_windows_are_off_centre(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "key string, t long, v double")
    for n in (3, 4, 5):
        got = [r.smooth for r in sq.moving_average(df, ["key"], "t", "v", n).orderBy("t").collect()]
        assert np.allclose(got, np.convolve(x, np.ones(n) / n, mode="same"))


def test_dead_time_across_and_inside_runs(spark):
    df = spark.createDataFrame([("k", 10, 30)], "key string, start long, stop long")
    assert [r.t for r in sq.expand_runs_with_dead_time(df, ["key"], 5).orderBy("t").collect()] == [10, 16, 22, 28]
    assert [r.t for r in sq.expand_runs_with_dead_time(df, ["key"], 5, last=27).orderBy("t").collect()] == []


def test_statistics(spark):
    def one(values):
        return spark.createDataFrame([("k", float(v)) for v in values], "key string, v double")

    assert abs(st.gini(one([1, 1, 1, 1]), ["key"], "v").first().gini) < 1e-12
    assert abs(st.gini(one([0, 0, 0, 4]), ["key"], "v").first().gini - 0.6) < 1e-12
    assert sorted(round(r.z, 9) for r in st.robust_z(one([1, 2, 3, 4, 100]), ["key"], "v").collect()) == sorted(round(0.6745 * (x - 3), 9) for x in (1, 2, 3, 4, 100))
    assert {r.out for r in st.min_max(one([5, 5, 5]), ["key"], "v", "out").collect()} == {0.0}
    assert [r.n for r in st.histogram(one([0, 1, 2, 4]), ["key"], "v", 4).orderBy("bin").collect()] == [1, 1, 1, 1]
    assert st.effectiveness(one([0, 0, 1, 1]), ["key"], "v").first().effectiveness == 1
    a, b = one([1, 2, 3, 4]), one([5, 6, 7, 8])
    assert st.ks_statistic(a, b, ["key"], "v").first().d == 1


def test_epochs(spark):
    df = spark.createDataFrame([(0, 3), (1, 4), (2, 5)], "e long, n long")
    assert [(r.start_sample, r.stop_sample) for r in pt.mergepoints(df, [], "e", "n", 1.0, 1).orderBy("e").collect()] == [(0, 3), (3, 7), (7, 12)]
    bad = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "s string, rate int, ch int")
    with pytest.raises(ValueError):
        pt.multi_session(bad, "s", ["s"], "rate", "ch")
    with pytest.raises(ValueError):
        pt.multi_session(bad.filter("s = 'a'"), "s", ["s"], "rate", "ch")


def test_channel_partitions(spark):
    rows = [(i, c, p, s) for i, c, p, s in zip(range(8), [1, 1, 1, 0, 1, 1, 1, 1], [1] * 4 + [2] * 4, [1, 1, 2, 2] * 2)]
    ch = spark.createDataFrame([(i, bool(c), p, s) for i, c, p, s in rows], "ch long, connected boolean, probe int, shank int")
    out = spark.createDataFrame([(1,)], "ch long")
    assert sorted(r.channels for r in pt.sorter_partitions(ch, "probe", out).collect()) == [[0, 2], [4, 5, 6, 7]]
    assert sorted(r.channels for r in pt.sorter_partitions(ch, "shank").collect()) == [[0, 1], [2], [4, 5], [6, 7]]
    assert [r.channels for r in pt.sorter_partitions(ch, "all").collect()] == [[0, 1, 2, 4, 5, 6, 7]]


def test_correlogram_includes_the_zero_lag(spark):
    a = spark.createDataFrame([(1, 0), (1, 2000)], "unit long, t long")
    b = spark.createDataFrame([(2, 1000)], "unit long, t long")
    assert [r.n for r in un.correlogram(a, b, "t", 1000, 2).orderBy("bin").collect()] == [0, 1, 0, 1, 0]
    assert [r.n for r in un.correlogram(a, a, "t", 1000, 2).orderBy("bin").collect()] == [1, 0, 2, 0, 1]


def test_noise_rules(spark):
    columns = "unit string, isi_violations_ratio double, isi_violations_count double, presence_ratio double, snr double, amplitude_median double, firing_rate double, label string"
    units = spark.createDataFrame([("A", 6.0, 10.0, 1.0, 5.0, -50.0, 2.0, "good"), ("B", 6.0, 60.0, 1.0, 5.0, -50.0, 2.0, "good"), ("C", 0.0, 0.0, None, 5.0, -50.0, 2.0, "good"), ("D", 0.0, 0.0, 1.0, 5.0, -50.0, 0.01, "good")], columns)
    settings = config.NoiseRules(peak_to_valley=None, half_width=None)
    got = {r.unit: r.label for r in un.noise_rules(units, settings.rules(), settings.together()).collect()}
    assert got == {"A": "good", "B": "noise", "C": "good", "D": "noise"}


def test_state_rules(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.9), (0.1, 0.1, 0.9), (0.1, 0.9, 0.9), (0.1, 0.1, 0.1)], "sw double, emg double, th double")
    assert [r.state for r in ss.classify(df, "sw", "emg", "th", 0.5, 0.5, 0.5).collect()] == ["NREM", "REM", "WAKE", "WAKE"]


def test_dip_tells_one_mode_from_two():
    rng = np.random.default_rng(0)
    one, two = ss.dip_statistic(rng.normal(size=400)), ss.dip_statistic(np.concatenate([rng.normal(-4, 1, 200), rng.normal(4, 1, 200)]))
    assert one < 0.03 and two > 3 * one
    assert ss.dip_statistic(np.ones(9)) <= 0.06


def test_filters_do_not_depend_on_the_chunk(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "ch int, s long, v double")
    taps = sg.sinc_kernel(0.05, 0.3, 1.0, 20)
    want = np.convolve(np.pad(x, 20, mode="edge"), taps, mode="valid")
    for chunk in (40, 128, 1000):
        got = [r.v for r in sg.filtered(df, ["ch"], "s", "v", 0.05, 0.3, 1.0, 20, chunk).orderBy("s").collect()]
        assert np.allclose(got, want)
    t = np.arange(600)
    wave = spark.createDataFrame([(1, int(i), float(np.cos(2 * np.pi * 0.05 * i))) for i in t], "ch int, s long, v double")
    phase = np.array([r.v for r in sg.analytic_phase(wave, ["ch"], "s", "v", 600, 100).orderBy("s").collect()])
    assert np.allclose(np.diff(np.unwrap(phase))[50:-50], 2 * np.pi * 0.05, atol=0.01)


def test_whitening_gives_the_identity(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(3, 3))
    x = rng.normal(size=(300, 3)) @ mix
    df = spark.createDataFrame([(c, i, float(x[i, c])) for i in range(300) for c in range(3)], "ch int, s long, v double")
    white = sg.whitened(df, "s", "v", *sg.whitening_matrix(sg.channel_covariance(df, "s", "v")))
    cov = {(r.ch, r.other): r.moment for r in sg.channel_covariance(white, "s", "v").collect()}
    assert all(abs(v - (a == b)) < 1e-3 for (a, b), v in cov.items())


def test_special_functions(spark):
    p = [0.001, 0.025, 0.3, 0.5, 0.975, 0.9999]
    z = [r.z for r in spark.createDataFrame([(x,) for x in p], "p double").select(special.normal_quantile(F.col("p")).alias("z")).collect()]
    assert np.allclose([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], p, atol=1e-7)
    assert abs(special.chi2_cdf(3.841458820694124, 1) - 0.95) < 1e-9 and special.poisson_quantile(0.5, 3.0) == 3


def test_geometry_and_text(spark):
    got = geometry.layout(spark, "poly2", [[0, 1, 2, 3]], 20.0).orderBy("ch").collect()
    assert [(r.x, r.y) for r in got] == [(0, 0), (20, -10), (0, -20), (20, -30)]
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    df = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (10.5, 5.0)], "x double, y double")
    got = df.select(fl.in_polygon(F.col("x"), F.col("y"), square).alias("i"), fl.near_polyline(F.col("x"), F.col("y"), square, 1.0).alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True)]
    names = spark.createDataFrame([(x,) for x in ("day10_b", "day2_a", "Day2_B")], "n string")
    assert [r.n for r in names.orderBy(text.natural_key(F.col("n"))).collect()] == ["day2_a", "Day2_B", "day10_b"]
    times = spark.createDataFrame([("rec_240131_120005",), ("2024-01-31_12-00-05",), ("none",)], "n string").select(text.folder_time(F.col("n")).alias("t")).collect()
    assert str(times[0].t) == str(times[1].t) == "2024-01-31 12:00:05" and times[2].t is None
    flags = spark.createDataFrame([("Yes",), ("0",), ("x",)], "v string").select(text.to_bool(F.col("v")).alias("b")).collect()
    assert [r.b for r in flags] == [True, False, None]


def test_clusters_of_a_graph(spark):
    cliques = [(a, b) for base in (0, 10, 20) for a in range(base, base + 6) for b in range(base, base + 6) if a != b] + [(5, 10), (10, 5), (15, 20), (20, 15)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in cliques], "src long, dst long, w double")
    labels = so.modularity_clusters(edges)
    found = {r.node: r.cluster for r in labels.collect()}
    assert len({found[n] for n in range(6)}) == len({found[n] for n in range(10, 16)}) == len({found[n] for n in range(20, 26)}) == 1
    assert so.modularity(edges, labels).first().modularity > 0.5
    assert len(so.merge_tree(so.cluster_links(edges, labels))) == 2
    tree = spark.createDataFrame([(10, 1, 2), (11, 10, 3)], "parent long, left long, right long")
    assert sorted((r.parent, r.leaf) for r in su.tree_leaves(tree).collect()) == [(10, 1), (10, 2), (11, 1), (11, 2), (11, 3)]


def test_isolation_and_knn_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(3, 1, (50, 3))])
    df = spark.createDataFrame([(i, int(i >= 60), [float(v) for v in row]) for i, row in enumerate(x)], "id long, unit int, x array<double>")
    got = {r.unit: r for r in wv.isolation(df, "unit", "x", 3).collect()}
    for u, own, other in ((0, x[:60], x[60:]), (1, x[60:], x[:60])):
        cov = np.cov(own.T)
        d = np.sort(np.einsum("ij,jk,ik->i", other - own.mean(0), np.linalg.inv(cov), other - own.mean(0)))
        want = d[len(own) - 1] if len(d) >= len(own) else None
        assert (got[u].isolation is None) == (want is None) and (want is None or abs(got[u].isolation - want) < 1e-4 * want)
    near = jn.knn(df.filter("id % 10 = 0"), df.withColumnRenamed("id", "n"), "id", "n", "x", 4).collect()
    for r in near:
        d = np.sqrt(((x - x[r.id]) ** 2).sum(1))
        assert abs(np.sort(d)[r.rank - 1] - r.distance) < 1e-6
    assert len(near) == 11 * 4


def test_plugins(spark):
    plugins.METRICS.clear()
    plugins.metric("n")(lambda s: s.groupBy("unit").agg(F.count(F.lit(1)).alias("n")))
    plugins.metric("top")(lambda s: s.filter("v > 1").groupBy("unit").agg(F.max("v").alias("top")))
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 0.5)], "unit long, v double")
    assert {(r.unit, r.n, r.top) for r in plugins.compute(df).collect()} == {(1, 2, 3.0), (2, 1, None)}
    with pytest.raises(KeyError):
        plugins.compute(df, ["none"])


def test_previous_of_nulls(spark):
    df = spark.createDataFrame([("k", 0, None), ("k", 1, 5), ("k", 2, None)], "key string, t long, v long")
    assert [(r.p, r.any) for r in previous(df.withColumn("one", F.lit(1)), ["key"], "t", [], {"p": "v", "any": "one"}, 1).orderBy("t").collect()] == [(None, None), (None, 1), (5, 1)]


def test_zero_filled_epochs_refuse_other_lengths(spark):
    epochs = spark.createDataFrame([(1, 2), (2, 3)], "e long, n long")
    side = spark.createDataFrame([(1, 0, 7), (1, 1, 8)], "e long, i long, w long")
    assert [(r.e, r.i, r.w) for r in ev.zero_filled_epochs(epochs, side, ["e"], "n", "w").orderBy("e", "i").collect()] == [(1, 0, 7), (1, 1, 8), (2, 0, 0), (2, 1, 0), (2, 2, 0)]
    with pytest.raises(Exception, match="another length"):
        ev.zero_filled_epochs(epochs.withColumn("n", F.col("n") + 1), side, ["e"], "n", "w").collect()
