"""Layouts, ties and signs that the smallest tables don't hold."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.functions import geometry
from tidelane.operators import events as ev
from tidelane.operators import joins as jn
from tidelane.operators import matching as mt
from tidelane.operators import meetings as me
from tidelane.operators import results as rs
from tidelane.operators import sequences as sq
from tidelane.operators import sorting as so
from tidelane.operators import units as un
from tidelane.operators import waveforms as wv
from tidelane.plans import catalog
from tidelane.plans.stat_queries import rounded

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def thin(spark):
    """Vectors of two units over more tasks than rows."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(v) for v in rng.normal(size=3) + 4 * (i % 2)], [float(v) for v in rng.normal(size=5)]) for i in range(24)]
    df = spark.createDataFrame(rows, "vec_id long, unit int, x array<double>, wave array<double>")
    return df.repartition(30), np.array([r[2] for r in rows])


def test_moments_of_tasks_without_rows(spark, thin):
    df, x = thin
    for r in wv.moments(df, "unit", "x", 3).collect():
        own = x[r.unit :: 2]
        assert r.n == 12 and np.allclose(r.second, (own.T @ own / 12).ravel())
    axes = wv.principal_axes(df, "x", 3, 2)
    assert np.allclose(np.abs(axes @ np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]), np.eye(2), atol=1e-9)
    assert wv.isolation(df, "unit", "x", 3).count() == 2
    assert wv.outlier_split(df, df.select("vec_id", "wave"), "vec_id", "unit", "x", 3).count() == 24
    assert wv.bimodal_split(df, "vec_id", "unit", "x", 3, rounds=1, least=4).count() == 24
    assert len(set(mt.seeds(df, "vec_id", "x", 2))) == 2


def test_coherence_of_single_bins_and_flat_maps(spark):
    rows = [("one", 0, 2.0), ("flat", 0, 1.0), ("flat", 1, 1.0), ("flat", 2, 1.0), ("up", 0, 1.0), ("up", 1, 2.0), ("up", 2, 4.0)]
    found = {r.unit: r.coherence for r in un.spatial_coherence(spark.createDataFrame(rows, "unit string, bin long, rate double"), ["unit"]).collect()}
    assert found["one"] is None and found["flat"] is None
    assert found["up"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 2.5, 2])[0, 1])


def test_rounded_zeros_keep_their_sign(spark):
    df = spark.createDataFrame([([-1e-9, 1e-9, 0.0, -0.0, -1.5, 0.123456789],)], "x array<double>")
    got = df.select(rounded("x", 5)).first().x
    want = duckdb.sql("SELECT list_transform([-1e-9, 1e-9, 0.0, '-0.0'::DOUBLE, -1.5, 0.123456789], lambda x: round(x, 5))").fetchall()[0][0]
    assert list(map(repr, got)) == list(map(repr, map(float, want))) == ["-0.0", "0.0", "0.0", "-0.0", "-1.5", "0.12346"]


@pytest.mark.parametrize("name,column", [("o_wv_04_moments", "second"), ("o_sup_07_l2_normalised", "x"), ("o_sup_10_scaled_templates", "wave"), ("o_sup_03_gathered_features", "gathered")])
def test_arrays_equal_the_sql_to_the_sign(spark, tmp_path, name, column):
    """Vectors with tiny negative numbers."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 64)) * np.where(rng.random((40, 64)) < 0.3, 1e-9, 1.0)
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.sql(catalog.ORACLE_SQL[name])
    want = {r[1 - found.columns.index(column)]: list(map(repr, r[found.columns.index(column)])) for r in found.fetchall()}
    got = {r[0]: list(map(repr, r[1])) for r in catalog.QUERIES[name](spark, str(tmp_path)).select([c for c in found.columns if c != column][0], column).collect()}
    assert any("-0.0" in v for v in want.values())
    assert got == want


def test_channels_of_equal_size_go_by_name(spark):
    waves = spark.createDataFrame([(1, 4, 2.0, "view"), (1, 5, 2.0, "signup"), (1, 1, 2.0, "click"), (2, 4, 1.0, "view"), (2, 5, 1.0, "signup")], "unit long, ch long, ptp double, name string")
    places = spark.createDataFrame([(1, 0.0, 0.0), (4, 0.0, 60.0), (5, 0.0, 200.0)], "ch long, x double, y double")
    best = rs.sparse_channels(waves, places, "best_channels", 2, "name").collect()
    assert sorted(map(tuple, best)) == [(1, 1), (1, 5), (2, 4), (2, 5)]
    assert sorted(map(tuple, rs.sparse_channels(waves, places, "radius", 1.0, "name").collect())) == [(1, 1), (2, 5)]
    assert sorted(map(tuple, rs.sparse_channels(waves, places, "radius", 1.0).collect())) == [(1, 1), (2, 4)]


@pytest.mark.parametrize("n", [515, 516, 517, 600, 601])
def test_staggered_sides_don_t_depend_on_the_number_of_sites(spark, n):
    found = geometry.layout(spark, "staggered", [list(range(n))]).orderBy(F.desc("ch")).limit(6).collect()
    assert [r.x for r in found] == [0.0, -8.5, 17.0, -21.0, 25.0, -29.0]


def test_knn_compares_rounded_distances(spark):
    items = spark.createDataFrame([(7, [1.00004]), (9, [1.0]), (3, [1.2])], "item long, x array<double>")
    q = spark.createDataFrame([(0, [0.0])], "q long, x array<double>")
    of = lambda **more: [(r.item, r.distance) for r in jn.knn(q, items, "q", "item", "x", 2, **more).orderBy("rank").collect()]
    assert of(digits=4) == [(7, 1.0), (9, 1.0)]
    assert [i for i, _ in of()] == [9, 7]


def close_counts(spikes, bin_width, n_bins):
    """unit, other -> counts by bin, pair by pair."""
    found = {}
    window = bin_width * n_bins + bin_width / 2
    for u, s in spikes:
        for o, t in spikes:
            lag = t - s
            if -window <= lag < window and abs(np.rint(lag / bin_width)) <= n_bins:
                found.setdefault((u, o), np.zeros(2 * n_bins + 1, int))[int(np.rint(lag / bin_width)) + n_bins] += 1
    return found


@pytest.mark.parametrize("labels,pairs", [(384, 1 << 27), (2, 1 << 27), (2, 40), (384, 3)])
def test_correlograms_in_cells(spark, monkeypatch, labels, pairs):
    """Every pair is counted once, however units are dealt out and cells are cut along time; windows are open at their end."""
    monkeypatch.setattr(un, "CELL_LABELS", labels)
    monkeypatch.setattr(un, "CELL_PAIRS", pairs)
    rng = np.random.default_rng(11)
    rows = [(int(u), int(t)) for u, t in zip(rng.integers(0, 7, 150), rng.integers(0, 2000, 150))] + [(8, 0), (9, 25), (None, 500), (3, None)]
    df = spark.createDataFrame(rows, "unit long, t long")
    want = close_counts([r for r in rows if r[1] is not None], 10, 2)
    got = {(r.unit, r.other): list(r.n) for r in un.correlogram_rows(df, df, "t", 10, 2).collect()}
    assert got == {k: list(v) for k, v in want.items()}
    assert un.correlogram(df, df, "t", 10, 2).count() == 5 * len(want)
    plan = un.correlogram_rows(df, df, "t", 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # pairs of spikes are never rows


@pytest.mark.parametrize("labels,pairs", [(384, 1 << 27), (2, 40)])
def test_correlograms_by_keys(spark, monkeypatch, labels, pairs):
    monkeypatch.setattr(un, "CELL_LABELS", labels)
    monkeypatch.setattr(un, "CELL_PAIRS", pairs)
    rng = np.random.default_rng(12)
    rows = [(str(k), int(u), int(t)) for k, u, t in zip(rng.integers(0, 2, 150), rng.integers(0, 5, 150), rng.integers(0, 1000, 150))]
    df = spark.createDataFrame(rows, "day string, unit long, t long")
    want = {(d, *k): list(v) for d in "01" for k, v in close_counts([r[1:] for r in rows if r[0] == d], 10, 2).items()}
    assert {(r.day, r.unit, r.other): list(r.n) for r in un.correlogram_rows(df, df, "t", 10, 2, ["day"]).collect()} == want


@pytest.mark.parametrize("scan", [0, 600])
@pytest.mark.parametrize("n_bins,kind", [(2, int), (3, int), (3, float)])
def test_trains_count_by_slices_and_by_searches(monkeypatch, scan, n_bins, kind):
    """Lags of half a bin, which round to even bins, included."""
    monkeypatch.setattr(me, "SCAN", scan)
    rng = np.random.default_rng(5)
    y, p = np.sort(rng.integers(0, 400, 300)).astype(kind), rng.integers(0, 6, 300).astype(np.int32)
    edges = me.lag_edges(10, n_bins, kind is int)
    for code in range(6):
        x = y[p == code]
        train = me.Train(code, x, y, p, 7, edges)
        lag = y[None, :] - x[:, None]
        bins = np.where((lag >= -10 * n_bins - 5) & (lag < 10 * n_bins + 5), np.rint(lag / 10), 99)
        want = np.array([[((bins == k) & (p == o)).sum() for o in range(7)] for k in range(-n_bins, n_bins + 1)])
        hit, n = train.others()
        assert (hit == np.flatnonzero(want.any(axis=0))).all() and (n == want[:, hit]).all()
        assert (train.everyone() == want.sum(axis=1)).all() and (train.itself() == want[:, code]).all()


def test_correlograms_of_two_sides(spark):
    """Units of one side only, null units and times, names that aren't numbers, more tasks than one."""
    rng = np.random.default_rng(13)
    a, b = ([(None if u == 0 else f"u{u}", None if t == 7 else float(t)) for u, t in zip(rng.integers(0, hi, 200), rng.integers(0, 500, 200))] for hi in (70, 90))
    want = {}
    for u, s in a:
        for o, t in b:
            if s is not None and t is not None and -25 <= t - s < 25 and abs(np.rint((t - s) / 10)) <= 2:
                want.setdefault((u, o), [0] * 5)[int(np.rint((t - s) / 10)) + 2] += 1
    dfs = [spark.createDataFrame(side, "unit string, t double") for side in (a, b)]
    assert {(r.unit, r.other): list(r.n) for r in un.correlogram_rows(*dfs, "t", 10, 2).collect()} == want
    assert un.correlogram_rows(dfs[0].limit(0), dfs[1], "t", 10, 2).count() == 0 == un.correlogram_rows(dfs[0].limit(0), dfs[0].limit(0), "t", 10, 2).count()


PAIRED = ["o_ccg_01_correlogram", "o_ccg_02_metrics", "o_ccg_03_refractory", "o_ccg_05_rate_correlogram", "o_ccg_09_population_modulation", "o_ccg_10_connections", "o_ccg_11_baseline", "o_ccg_11_transmission", "o_srt_24_shape_gate"]


@pytest.mark.parametrize("name", PAIRED)
def test_r03_pairs_of_units_are_not_exchanged(spark, tmp_path, name):
    """F1 F2 F3 F5 F6 F7 F8 F9 F10: neither spikes nor pairs are copied to other tasks, and null units and units of a single spike give what the SQL gives."""
    apart = name[2:8] in ("ccg_09", "ccg_10", "ccg_11", "srt_24")  # the others' SQL loses the counts of null units
    rows = [(i, 3_600_000_000 * int(h) + int(m), None if u == 0 and apart else int(u)) for i, (h, m, u) in enumerate(np.random.default_rng(7).integers(0, [60, 1_800_000_000, 40], (400, 3)))] + [(900, 9_000_000_000_000, 50)]
    spark.createDataFrame(rows, "event_id long, t long, user_id long").selectExpr("event_id", "timestamp_micros(t) AS ts", "user_id", "'view' AS event_type", "1.0D AS value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = duckdb.sql(catalog.ORACLE_SQL[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    key = lambda r: tuple((v is None, v) for v in r)
    assert len(want) > 20 and sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_baselines_of_rows_equal_those_of_bins(spark):
    rng = np.random.default_rng(2)
    rows = [(u, o, [int(v) for v in rng.poisson(3, 25) + 30 * (np.arange(25) == 13) * (u < o)]) for u in range(4) for o in range(4)]
    wide = spark.createDataFrame(rows, "unit long, other long, n array<long>")
    long = un.long_rows(wide, ["unit", "other"], -12, {"n": "n"})
    want = {(r.unit, r.other, r.bin): (r.baseline, r.excess) for r in un.excess_bins(long, ["unit", "other"], 3.0, 6, 0.05).collect()}
    found = un.excess_rows(wide, ["unit", "other"], 25, 3.0, 6, 0.05)
    got = {(r.unit, r.other, r.bin): (r.baseline, r.excess) for r in un.long_rows(found, ["unit", "other"], -12, {"baseline": "baseline", "excess": "excess"}).collect()}
    assert got.keys() == want.keys() and any(e for _, e in want.values())
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want)
    one = spark.createDataFrame([(u, t) for u in range(4) for t in range(5)], "unit long, t long")
    gains = {(r.unit, r.other): r.probability for r in un.transmission(un.excess_bins(long, ["unit", "other"], 3.0, 6, 0.05), one, ["unit", "other"]).collect()}
    assert all(r.gain / 5 == pytest.approx(gains[r.unit, r.other]) for r in found.collect())


def test_shape_gate_of_rows_equals_that_of_bins(spark):
    rng = np.random.default_rng(4)
    rows = [(u, o, [int(v) for v in rng.poisson(2 + (u == o), 25)]) for u in range(5) for o in range(5) if (u, o) != (4, 4)] + [(7, 8, [0] * 25), (7, 7, [3] * 25)]
    wide = spark.createDataFrame(rows, "unit long, other long, n array<long>")
    near = lambda found: {(r.unit, r.other): tuple(v if v is None else round(v, 9) for v in (r.r_unit, r.r_other)) + (r.alike,) for r in found.collect()}
    got = near(un.shape_gate_rows(wide, 12, 2, 12, 0.3))
    assert got == near(un.shape_gate(un.long_rows(wide, ["unit", "other"], -12, {"n": "n"}), 2, 12, 0.3))
    assert got[0, 4][1] is None and got[7, 8] == (None, None, False)


def test_psth_in_cells_equals_pairs(spark, monkeypatch):
    """Bins are open at their end, kinds of events are told apart, and units without spikes near any event have zeros."""
    monkeypatch.setattr(un, "CELL_WINDOWS", 1)
    rng = np.random.default_rng(8)
    events = [(k, int(t)) for k, t in zip(rng.choice(["a", "b"], 30), rng.integers(0, 400, 30))] + [("a", None)]
    rows = [(int(u), int(t)) for u, t in zip(rng.integers(0, 5, 200), rng.integers(0, 400, 200))] + [(9, 100_000), (3, None)]
    found = un.psth(spark.createDataFrame(events, "kind string, t long"), spark.createDataFrame(rows, "unit long, t long"), "t", 10, 3, 10.0, ["kind"])
    got = {(r.kind, r.unit, r.bin): (r.n, r.rate) for r in found.collect()}
    assert len(got) == 2 * 6 * 6
    for (kind, unit, b), (n, rate) in got.items():
        own = [t for k, t in events if k == kind]
        want = sum(10 * b <= t - e < 10 * (b + 1) for e in own if e is not None for u, t in rows if u == unit and t is not None)
        assert n == want and rate == pytest.approx(want / len(own))
    assert un.psth(spark.createDataFrame(events, "kind string, t long"), spark.createDataFrame(rows, "unit long, t long"), "t", 10, 3, 10.0).count() == 36


@pytest.mark.parametrize("nested", [False, True])
def test_participation_in_cells_equals_pairs(spark, monkeypatch, nested):
    monkeypatch.setattr(un, "CELL_WINDOWS", 1)
    rng = np.random.default_rng(9)
    starts = sorted(int(t) for t in rng.integers(0, 500, 25))
    events = [(i, s, s + (int(rng.integers(-3, 60)) if nested else 20)) for i, s in enumerate(starts)]
    rows = [(int(u), int(t)) for u, t in zip(rng.integers(0, 4, 120), rng.integers(0, 500, 120))] + [(1, 50), (1, 50), (8, 10_000)]
    found = un.participation(spark.createDataFrame(rows, "unit long, t long"), spark.createDataFrame(events, "event long, start long, stop long"), "t", 20, 1.0).collect()
    assert len(found) == 5
    for r in found:
        own = [sum(u == r.unit and s <= t <= e for u, t in rows) for _, s, e in events]
        assert r.participation == pytest.approx(sum(n > 0 for n in own) / 25) and r.spikes_per_event == pytest.approx(sum(own) / 25)
        assert r.rate_inside == pytest.approx(sum(own) / sum(e - s for _, s, e in events))


def test_metrics_of_rows_equal_those_of_bins(spark):
    rng = np.random.default_rng(6)
    rows = [(u, o, [int(v) for v in rng.poisson(u, 25)]) for u in range(4) for o in range(4)]
    wide = spark.createDataFrame(rows, "unit long, other long, n array<long>")
    long = un.long_rows(wide, ["unit", "other"], -12, {"n": "n"})
    of = lambda found: sorted(tuple(v if v is None else round(v, 9) for v in r) for r in found.collect())
    found = un.correlogram_metrics(wide, ["unit", "other"], (6, 12), (3, 6), 3, 12)
    assert of(found) == of(un.correlogram_metrics(long, ["unit", "other"], (6, 12), (3, 6), 3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_words_of_one_time_don_t_depend_on_the_rows_order(spark):
    rows = [("k", t, w) for t, ws in ((0, (3, 0)), (10, (5, 1, 2)), (20, (0,)), (30, (7, 4))) for w in ws]
    kind = "ch string, t long, word long"
    found = []
    for part in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(part, kind).coalesce(1)
        found.append((sorted(ev.word_intervals(df, ["ch"], "t", "word", F.lit(40)).collect()), sorted(map(str, ev.digital_pulses(df, ["ch"], "t", "word", 3).collect()))))
    assert found[0] == found[1] == found[2]
    assert [tuple(r) for r in found[0][0]] == [("k", 0, 9, 3), ("k", 10, 19, 5), ("k", 20, 29, 0), ("k", 30, 39, 7)]


def disk_bytes(spark):
    """Bytes that Spark's shuffles and checkpoints hold."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    stored = Path((spark.sparkContext.getCheckpointDir() or "file:/nowhere").split(":", 1)[-1])
    return sum(files.apply(i).length() for i in range(files.size())) + sum(p.stat().st_size for p in stored.rglob("*") if p.is_file())


def test_f1_ranks_in_events_are_no_rows(spark):
    spikes = spark.range(900).selectExpr("id % 300 AS unit", "id * 3 AS t")
    spans = spark.range(1500).selectExpr("id AS event", "id AS start", "id + 2000 AS stop")
    before = disk_bytes(spark)
    rows = sq.rank_in_events(spikes, spans, "t", 2000, 3).collect()
    assert len(rows) == 300 and sum(r.n_events for r in rows) > 400_000
    assert disk_bytes(spark) - before < 2_000_000


def test_f1_ranks_of_odd_events(spark, monkeypatch):
    """Ties, events of several spans, null events and units, empty spans, hot cells, and medians found in one pass or in many."""
    rng = np.random.default_rng(5)
    spikes = [(int(u) if u else None, int(t) if t else None) for u, t in zip(rng.integers(0, 25, 600), rng.integers(0, 900, 600), strict=True)]
    spans = [(int(e) if e else None, int(s), int(s + d)) for e, s, d in zip(rng.integers(0, 60, 90), rng.integers(0, 800, 90), rng.integers(-9, 90, 90), strict=True)]
    expected = {}
    for event in {e for e, _, _ in spans}:
        first = {}
        for u, t in spikes:
            if t is not None and any(e == event and s <= t <= z for e, s, z in spans):
                first[u] = min(first.get(u, t), t)
        for u in first if len(first) >= 3 else ():
            expected.setdefault(u, []).append((1 + sum(x < first[u] for x in first.values())) / len(first))
    expected = {u: (float(np.median(r)), len(r)) for u, r in expected.items()}
    a, b = spark.createDataFrame(spikes, "unit long, t long"), spark.createDataFrame(spans, "event long, start long, stop long")
    for rows, events in ((1 << 24, 4096), (0, 4)):
        monkeypatch.setattr(sq, "RANK_ROWS", rows)
        monkeypatch.setattr(sq, "CELL_EVENTS", events)
        assert {r.unit: (r.rank_order, r.n_events) for r in sq.rank_in_events(a, b, "t", 30, 3).collect()} == expected
    assert sq.rank_in_events(a, b.limit(0), "t", 30, 3).count() == 0 == sq.rank_in_events(a.limit(0), b, "t", 30, 3).count()


def test_f18_f19_edges_of_coincidences_are_not_stored(spark):
    rows = spark.range(2400).selectExpr("id % 600 AS unit", "id AS t")
    before = disk_bytes(spark)
    g = so.Coincidences(rows, "t", 3000)
    label = g.clusters(rounds=2)
    assert g.labels(label).count() == 600 and (g.degree == 2 * 4 * 4 * 599).all()
    assert g.links(label).agg(F.sum("w")).first()[0] == g.total
    assert disk_bytes(spark) - before < 1_000_000


@pytest.mark.parametrize("name", ["o_srt_10_modularity_clusters", "o_srt_12_cluster_links"])
def test_f18_f19_no_edge_moves(spark, tmp_path, name):
    """Dense tables: 500 units, all of whose pairs coincide, make 249,500 edges."""
    spark.range(2000).selectExpr("id AS event_id", "timestamp_micros(id * 1000) AS ts", "id % 500 AS user_id", "'view' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    before = disk_bytes(spark)
    rows = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert rows and disk_bytes(spark) - before < 2_000_000


@pytest.mark.parametrize("tasks", [1, 7])
def test_f18_f19_coincidences_equal_their_edges(spark, monkeypatch, tasks):
    """Lags of just the reach, equal times, units and times that are null, units that meet none, and several pieces and tasks."""
    monkeypatch.setattr(so, "COINCIDENCE_TASKS", tasks)
    monkeypatch.setattr(so, "PIECE_ROWS", 100)
    rng = np.random.default_rng(8)
    rows = [(int(u), int(t)) for u, t in zip(rng.integers(0, 500, 900), rng.integers(0, 2000, 900) - 700, strict=True)] + [(9999, 9000), (9999, 9001), (None, 5), (3, None)]
    known = [r for r in rows if None not in r]
    u, t = np.array(known).T
    gap = t[None, :] - t[:, None]
    w = {}
    for i, j in zip(*np.nonzero((np.abs(gap) <= 4) & (u[None, :] != u[:, None])), strict=True):
        w[u[i], u[j]] = w.get((u[i], u[j]), 0.0) + (gap[i, j] < 4) + (gap[i, j] > -4)
    edges = spark.createDataFrame([(int(a), int(b), float(x)) for (a, b), x in w.items()], "src long, dst long, w double")
    g = so.Coincidences(spark.createDataFrame(rows, "unit long, t long"), "t", 4)
    label = g.clusters(rounds=3)
    expected = so.modularity_clusters(edges, rounds=3)
    assert sorted(g.labels(label).collect()) == sorted(expected.collect())
    assert sorted(g.links(label).collect()) == sorted(so.cluster_links(edges, expected).collect())
    none = so.Coincidences(spark.createDataFrame([(None, 1)], "unit long, t long"), "t", 4)
    assert none.labels(none.clusters()).count() == 0 == none.links(none.clusters()).count()


def test_r03_f11_modularity_moves_no_edge(spark, tmp_path):
    """600 units, all of whose pairs coincide, a null one and one below 0."""
    spark.range(2400).selectExpr("id AS event_id", "timestamp_micros(id * 1000 + IF(id < 9, 999999999999, 0)) AS ts", "IF(id = 7, NULL, id % 600 - 1) AS user_id", "'view' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    before = disk_bytes(spark)
    got = catalog.QUERIES["o_srt_12_modularity"](spark, str(tmp_path)).collect()
    assert disk_bytes(spark) - before < 300_000
    assert [tuple(r) for r in got] == duckdb.sql(catalog.ORACLE_SQL["o_srt_12_modularity"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    spark.range(1).selectExpr("id AS event_id", "timestamp_micros(id) AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/one/events.parquet")
    assert [r.modularity for r in catalog.QUERIES["o_srt_12_modularity"](spark, f"{tmp_path}/one").collect()] == [None]


@pytest.mark.parametrize("pairs", [1 << 18, 300])
def test_r03_f4_templates_are_not_exchanged(spark, monkeypatch, pairs):
    """All pairs once, however products are cut; templates of zeros have no similarity, null units no pairs."""
    monkeypatch.setattr(un, "SIMILAR_PAIRS", pairs)
    rng = np.random.default_rng(21)
    rows = [(None if i == 5 else int(u), [0.0] * 6 if i == 8 else [float(v) for v in rng.poisson(0.4, 6)]) for i, u in enumerate(rng.permutation(200) - 100)]
    df = spark.createDataFrame(rows + [(3, [1.0] * 6), (4, None)], "unit long, wave array<double>").coalesce(3)
    found = un.template_similarity(df, "unit", "wave")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    known = [r for r in rows + [(3, [1.0] * 6)] if r[0] is not None]
    cosine = lambda x, y: np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) if any(x) and any(y) else None
    key = lambda r: (r[0], r[1], -1 if r[2] is None else round(r[2], 9))
    want = sorted(key((a, b, cosine(x, y))) for a, x in known for b, y in known if a < b)
    assert sorted(key(r) for r in found.collect()) == want
    some = un.template_similarity(df, "unit", "wave", 0.0, 3).collect()
    assert len(some) == sum(s > 0 for _, _, s in want) and all(r.similarity == round(r.similarity, 3) for r in some)
    assert un.template_similarity(df.limit(0), "unit", "wave").count() == 0
