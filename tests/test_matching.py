import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.operators import matching as mt
from tidelane.operators import units as un
from tidelane.operators import waveforms as wv

SIZE = 12


@pytest.fixture(scope="module")
def scene(spark):
    """Two templates on three channels, planted at known places, two of them overlapping."""
    rng = np.random.default_rng(3)
    w = np.stack([np.outer([1.0, 0.5, 0.0], np.sin(np.arange(SIZE) / 2)), np.outer([0.0, 0.4, 1.0], np.cos(np.arange(SIZE) / 3) * np.hanning(SIZE))]) * 20
    x = rng.normal(0, 0.3, (3, 2000))
    planted = [(0, 100, 1.0), (1, 300, 1.2), (0, 511, 0.9), (1, 515, 1.0), (0, 1015, 1.1), (1, 1700, 1.0)]
    for u, s, a in planted:
        x[:, s : s + SIZE] += a * w[u]
    samples = spark.createDataFrame([(c, s, float(x[c, s])) for c in range(3) for s in range(2000)], "ch int, s long, v double")
    templates = spark.createDataFrame([(u, c, k, float(w[u, c, k])) for u in range(2) for c in range(3) for k in range(SIZE)], "unit int, ch int, lag int, value double")
    return samples, templates, planted


@pytest.mark.parametrize("chunk", [128, 512, 4096])
def test_planted_templates_are_found_once(scene, chunk):
    samples, templates, planted = scene
    got = sorted((r.unit, r.s, r.amplitude) for r in mt.matched(samples, templates, "s", "v", [0, 1, 2], SIZE, 20.0, chunk, 4).collect())
    assert [g[:2] for g in got] == sorted(p[:2] for p in planted)
    assert all(abs(g[2] - p[2]) < 0.15 for g, p in zip(got, sorted(planted)))


def test_seeds_explain_most(spark):
    df = spark.createDataFrame([(i, [float(x), 1.0]) for i, x in enumerate([10, 10.1, -10, -10.1, 0.1, 0, 30])], "id long, x array<double>")
    assert mt.seeds(df, "id", "x", 3)[0] == 6
    found = mt.seeds(df, "id", "x", 3)
    assert len({i // 2 for i in found[:3]} & {0, 1, 3}) == 3 and found == mt.seeds(df.repartition(3), "id", "x", 3)
    assert len(mt.seeds(spark.createDataFrame([(1, [2.0]), (2, [2.0])], "id long, x array<double>"), "id", "x", 2)) == 1


def test_acg_fit_recovers_the_decay(spark):
    x = np.arange(1, 60)
    y = np.maximum(5 * (np.exp(-(x - 0.5) / 15.0) - np.exp(-(x - 0.5) / 2.0)) + 1, 0) * 100
    df = spark.createDataFrame([(1, int(b), float(v)) for b, v in zip(x, y)], "unit int, bin long, n double")
    row = mt.fit_acg(df, ["unit"], 1.0).first()
    assert row.r2 > 0.98 and 8 < row.tau_decay < 25


def test_merging_joins_split_neurons(spark):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.exponential(40, 3000) + 5)
    rows = [(1 if i % 2 else 2, int(v)) for i, v in enumerate(t)] + [(3, int(v)) for v in rng.uniform(0, t[-1], 1500)]
    spikes = spark.createDataFrame(rows, "unit long, t long")
    templates = spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [1.1, 2.0, 0.0]), (3, [1.0, 1.9, 0.1])], "unit long, wave array<double>")
    found = mt.merge_candidates(spikes, templates, "t", "wave", 0.9, 1, 100, (50, 100), (10, 50), 4)
    assert [(r.unit, r.other) for r in found.collect()] == [(1, 2)]
    assert {r.unit for r in mt.merged_units(spikes, found).select("unit").distinct().collect()} == {1, 3}
    clean = un.refractory(mt.contamination_matrix(mt.merged_units(spikes, found), "t", 1, 100, (50, 100), (10, 50), 4), 0.2, 0.2)
    assert {r.unit: r.refractory for r in clean.select("unit", "refractory").collect()} == {1: True, 3: False}


def test_trilateration(spark):
    places = [(c, float(c % 2 * 20), float(c // 2 * 20)) for c in range(16)]
    truth = {1: (7.0, 55.0, 25.0), 2: (18.0, 90.0, 40.0)}
    rows = [(u, c, 100 * float(np.exp(-np.hypot(x - a, y - b) / k)) + 3) for u, (a, b, k) in truth.items() for c, x, y in places] + [(3, 0, 5.0)]
    contacts = spark.createDataFrame(places, "ch int, x double, y double")
    got = {r.u: r for r in mt.trilaterate(spark.createDataFrame(rows, "u int, ch int, a double"), contacts, "u", "a").collect()}
    for u, (a, b, k) in truth.items():
        assert abs(got[u].x - a) < 0.5 and abs(got[u].y - b) < 0.5 and abs(got[u].length_constant - k) < 0.05 * k
    assert got[3].x is None and got[3].length_constant is None
    peaks = spark.createDataFrame([(1, 0, 3.0), (1, 1, 3.0), (1, 2, 0.1)], "unit int, ch int, a double")
    assert tuple(mt.weighted_centre(peaks, spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 0.0, 90.0)], "ch int, x double, y double"), "unit", "a", 2).first()) == (1, 5.0, 0.0)


def test_bimodal_split(spark):
    rng = np.random.default_rng(6)
    two = np.concatenate([rng.normal(0, 1, (400, 4)), rng.normal(0, 1, (350, 4)) + [0, 6, 0, 3]])
    one = rng.normal(0, 1, (600, 4)) + 5
    few = rng.normal(0, 1, (50, 4))
    rows = [(i, u, [float(v) for v in x]) for i, (u, x) in enumerate([*((1, x) for x in two), *((2, x) for x in one), *((3, x) for x in few)])]
    got = wv.bimodal_split(spark.createDataFrame(rows, "id long, unit int, x array<double>"), "id", "unit", "x", 4).collect()
    assert {(r.unit, r.split) for r in got} == {(1, True), (2, False), (3, False)}
    sides = {r.id: r.side for r in got if r.unit == 1}
    wrong = sum(sides[i] != (sides[0] if i < 400 else 1 - sides[0]) for i in range(750))
    assert wrong < 15
