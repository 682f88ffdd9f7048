"""Whole runs over made-up sessions, staging, probe files, exports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.operators import results as rs
from tidelane.plans import lifecycle as lc
from tidelane.sources import probes
from tidelane.sources import recordings as rc


def test_multi_day_staging(spark, tmp_path):
    """Sample counts 3, 4, 5 in three epochs of two days; streams or descriptions that disagree are errors."""
    rows = [("day1", "ep_240101_100000", 0, 3, 4, 20000.0), ("day1", "ep_240101_120000", 1, 4, 4, 20000.0), ("day2", "ep_240102_100000", 2, 5, 4, 20000.0)]
    schema = "session string, folder string, order long, n_samples long, n_channels int, rate double"
    session = lc.Session(spark, str(tmp_path / "a"))
    got = lc.stage_sessions(session, spark.createDataFrame(rows, schema), 20000.0).orderBy("order").collect()
    assert [(r.session, r.start_sample, r.stop_sample) for r in got] == [("day1", 0, 3), ("day1", 3, 7), ("day2", 7, 12)]
    lc.stage_sessions(session, spark.createDataFrame(rows, schema), 20000.0)
    assert session.ran == ["epochs"]  # the second time it is read
    again = lc.Session(spark, str(tmp_path / "a"), frozenset({"epochs"}))
    lc.stage_sessions(again, spark.createDataFrame(rows, schema), 20000.0)
    assert again.ran == ["epochs"]
    for bad in (("day2", "x", 3, 5, 5, 20000.0), ("day2", "x", 3, 5, 4, 30000.0)):
        with pytest.raises(Exception, match="differ in channels or rate"):
            lc.stage_sessions(lc.Session(spark, str(tmp_path / "b")), spark.createDataFrame([*rows, bad], schema), 20000.0)
    names = rs.multi_day_names(spark.createDataFrame(rows, schema).withColumn("g", F.lit(1)), ["g"], "order", "session").first().name
    assert names == "multiday_day1_to_day2"
    one = spark.createDataFrame([(1, "/a/b/c")], "g int, path string")
    assert rs.common_parent(one, ["g"], "path").first().parent == "/a/b"
    three = spark.createDataFrame([(1, "/a/b/c"), (1, "/a/b2/c"), (1, "/a/b/d"), (2, "x/y"), (2, "z/w")], "g int, path string")
    assert {r.g: r.parent for r in rs.common_parent(three, ["g"], "path").collect()} == {1: "/a", 2: "x"}


def test_settings_follow_the_descriptions(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<p><acquisitionSystem><nChannels>64</nChannels><samplingRate>30000</samplingRate></acquisitionSystem></p>")
    meta = rc.session_xml(spark, str(tmp_path / "s.xml")).first()
    found = spark.createDataFrame([("a/amplifier.dat", None, None), ("b/continuous.dat", 16, 30000.0)], "path string, stream_channels int, stream_rate double")
    got = {r.path: (r.source, r.n_channels, r.rate) for r in rs.source_info(found, meta.n_channels, meta.rate).collect()}
    assert got == {"a/amplifier.dat": ("raw", 64, 30000.0), "b/continuous.dat": ("stream", 16, 30000.0)}


def test_probe_files(spark, tmp_path):
    contacts = spark.createDataFrame([(2, 0.0, 20.0, 1.0), (0, 0.0, 0.0, 0.0), (1, 5.0, 10.0, 0.0)], "ch int, x double, y double, shank double")
    probes.save_probe(contacts, str(tmp_path / "p"), 8)
    back = probes.load_probe(spark, str(tmp_path / "p"))
    assert sorted(tuple(r) for r in back.collect()) == [(0, 0.0, 0.0, 0.0, 8), (1, 5.0, 10.0, 0.0, 8), (2, 0.0, 20.0, 1.0, 8)]
    (tmp_path / "q.json").write_text(json.dumps({"chanMap": [0, 1], "xc": [0], "yc": [0, 1], "n_chan": 2}))
    with pytest.raises(ValueError, match="one length"):
        probes.load_probe(spark, str(tmp_path / "q.json"))
    (tmp_path / "r.json").write_text(json.dumps({"chanMap": [0, 1], "yc": [0, 1], "n_chan": 2}))
    with pytest.raises(ValueError, match="xc"):
        probes.load_probe(spark, str(tmp_path / "r.json"))
    with pytest.raises(Exception, match="no such channel: 9"):
        rs.without_channels(contacts, spark.createDataFrame([(9,)], "ch int")).collect()


def test_tables_and_events(spark, tmp_path):
    rs.write_tables({"metrics": spark.range(3), "labels": spark.range(2)}, str(tmp_path / "t"))
    back = rs.read_tables(spark, str(tmp_path / "t"), ["metrics", "labels"])
    assert {n: df.count() for n, df in back.items()} == {"metrics": 3, "labels": 2}
    assert rs.empty_events(spark).columns == rs.event_table(spark.createDataFrame([(1.0,)], "t double"), "t", 2.0, 1.0).columns
    assert tuple(rs.event_table(spark.createDataFrame([(1.0,)], "t double"), "t", 2.0, 1.0).first()) == (0.0, 2.0, 1.0, 2.0)
    none = spark.createDataFrame([], "name string, start double, stop double")
    assert [tuple(r) for r in rs.session_epochs(none, "s1").collect()] == [("s1", 0.0, None)]
    with pytest.raises(TypeError, match="label"):
        rs.check_metrics(spark.range(1), {"id": "int", "label": "string"})
    with pytest.raises(ValueError):
        rs.pulse_table(None, None, None, None)
    assert bytes(rs.zero_frames(spark, 3, 2, 2).orderBy("first").collect()[1].data) == b"\0" * 4


def test_pulses_of_both_kinds(spark, tmp_path):
    words = spark.createDataFrame([(i, w) for i, w in enumerate([0, 1, 1, 0, 0, 2, 2, 0])], "t long, word int")
    level = spark.createDataFrame([("a", i, 100.0 if 20 <= i < 30 else float(i % 2)) for i in range(200)], "ch string, t long, value double")
    got = lc.export_events(lc.Session(spark, str(tmp_path)), words, level, "t", 10)
    rows = sorted(tuple(r) for r in got.collect())
    assert ("digital", "0", 0, 2) in rows and ("digital", "1", 4, 6) in rows and [r for r in rows if r[0] == "analog"] == [("analog", "a", 19, 29)]


@pytest.fixture(scope="module")
def recording():
    """Three channels of noise at 1 kHz with a negative pulse of two shapes on two of them."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (3, 20_000))
    places = np.arange(100, 19_900, 100)
    for i, p in enumerate(places):
        x[0 if i % 2 else 2, p - 3 : p + 4] -= np.array([2, 8, 20, 40, 20, 8, 2]) * (1 if i % 2 else 1.5)
    return x, places


def test_preprocess_and_sort(spark, tmp_path, recording):
    x, places = recording
    samples = spark.createDataFrame([(c, s, float(x[c, s])) for c in range(3) for s in range(x.shape[1])], "ch int, s long, v double")
    contacts = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 200.0), (2, 0.0, 400.0)], "ch int, x double, y double")
    session = lc.Session(spark, str(tmp_path))
    out = lc.preprocess(session, samples, "s", "v", 1000.0, contacts.filter("ch < 3"), 1.0, 450.0, None, 250.0)
    assert out["samples"].count() == x.size and out["lfp"].count() == x.size // 4
    found = lc.sort_spikes(session, out["samples"], "s", "v", contacts, 15.0, 16, 3)
    spikes = found["spikes"].collect()
    assert sorted(r.s for r in spikes) == places.tolist()
    assert len({r.unit for r in spikes}) == 2 and {(r.unit, r.ch) for r in spikes} == {(r.unit, 2 * r.unit) for r in spikes}
    before = list(session.ran)
    lc.sort_spikes(session, out["samples"], "s", "v", contacts, 15.0, 16, 3)
    assert session.ran == before
    metrics = spark.createDataFrame([(0, 0.5), (1, 0.01)], "unit long, firing_rate double")
    none = {c: F.lit(None).cast("double") for c in ("isi_violations_ratio", "isi_violations_count", "presence_ratio", "snr", "amplitude_median", "peak_to_valley", "half_width")}
    post = lc.postprocess(session, found["spikes"].select("unit", "s"), metrics.withColumns(none), found["labels"], "s", 150)
    assert {r.unit: r.label for r in post["labels"].collect()} == {0: "mua", 1: "noise"} or {r.unit: r.label for r in post["labels"].collect()} == {0: "good", 1: "noise"}
    summary = post["summary"].first()
    assert (summary.n_units_initial, summary.n_spikes_initial, summary.n_units_final, summary.n_noise) == (2, len(places), 2, 1)


def test_clusters_at_each_centre(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(5, 0.3, (60, 2)), rng.normal(0, 0.3, (20, 2))])
    rows = [(i, 0 if i < 120 else 7, [float(v) for v in p]) for i, p in enumerate(x)]
    got = {r.id: r.cluster for r in lc.clusters_by_centre(spark.createDataFrame(rows, "id long, centre int, x array<double>"), "centre", "id", "x", 8, 100).collect()}
    assert len(got) == 140 and len({got[i] for i in range(120, 140)}) == 1
    assert not {got[i] for i in range(60)} & {got[i] for i in range(60, 120)} and got[130] == max(got.values())
    assert sorted(set(got.values())) == list(range(len(set(got.values()))))


def test_state_scoring(spark, tmp_path):
    """Slow and fast halves of a signal become NREM and another state."""
    rng = np.random.default_rng(1)
    rate, seconds = 64, 240
    t = np.arange(rate * seconds) / rate
    slow = (t % 120) < 60
    x = np.stack([np.where(slow, 8 * np.sin(2 * np.pi * 1.5 * t), 0) + rng.normal(0, 1, len(t)) + 0.1 * c for c in range(3)])
    samples = spark.createDataFrame([(c, s, float(x[c, s])) for c in range(3) for s in range(x.shape[1])], "ch int, s long, v double")
    session = lc.Session(spark, str(tmp_path))
    out = lc.score_states(session, samples, "s", "v", float(rate), [0, 1, 2])
    spans = out["intervals"].collect()
    nrem = {int(v) for r in spans if r.state == "NREM" for v in range(int(r.start), int(r.stop) + 1)}
    truth = {s for s in range(seconds) if (s % 120) < 60}
    assert len(nrem & truth) > 0.8 * len(truth) and len(nrem - truth) < 0.15 * len(truth)
    assert {"packets", "nrem_episodes"} <= set(out) and "states" in session.ran


def test_depth_correction_moves_samples_back(spark):
    from tidelane.operators import signals as sg

    depths = [20.0 * i for i in range(12)]
    shape = lambda d: np.exp(-((np.array(depths) - 110 - d) ** 2) / (2 * 30**2))
    rows = [(c, s, float(shape(0 if s < 50 else 20)[c])) for s in range(100) for c in range(12)]
    shifts = spark.createDataFrame([(1, 20.0)], "batch long, shift double")
    out = {(r.ch, r.s): r.v for r in sg.drift_corrected(spark.createDataFrame(rows, "ch int, s long, v double"), "s", "v", list(range(12)), depths, shifts, 50, 20.0).collect()}
    assert len(out) == 1200
    before = [shape(0)[c] for c in range(12)]
    assert np.allclose([out[c, 10] for c in range(12)], before) and int(np.argmax([out[c, 80] for c in range(12)])) == int(np.argmax(before))


def test_command_line(spark, tmp_path, capsys):
    from tidelane.__main__ import main

    main(["list"])
    assert "o_int_03_merge_intervals *" in capsys.readouterr().out.splitlines()
    main(["run", "o_agg_02_count_units", "/root/testdata/sf0.001", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "a", "b"])
