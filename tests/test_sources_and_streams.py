import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.sources import recordings as rc
from tidelane.sources import sinks
from tidelane.streaming import events as se


def test_raw_recording(spark, tmp_path):
    x = np.arange(12_000, dtype="<i2").reshape(-1, 4)
    (tmp_path / "amplifier.dat").write_bytes(x.tobytes())
    blocks = rc.frames(spark, str(tmp_path / "amplifier.dat"), 4, block=100)
    got = rc.samples(blocks, 4, [1, 3], gain=0.5, offset=1.0)
    assert got.count() == 6000
    rows = {(r.ch, r.s): r.v for r in got.filter("s IN (0, 2999)").collect()}
    assert rows == {(1, 0): 1.5, (3, 0): 2.5, (1, 2999): x[2999, 1] * 0.5 + 1, (3, 2999): x[2999, 3] * 0.5 + 1}
    with pytest.raises(ValueError):
        rc.frames(spark, str(tmp_path / "amplifier.dat"), 7)
    with pytest.raises(ValueError):
        rc.samples(blocks, 4, [4])
    sinks.write_frames(rc.samples(blocks, 4), str(tmp_path / "out"), 500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert b"".join(bytes(r.data) for r in back.orderBy("first").collect()) == x.tobytes()
    assert sinks.validate_size(back, 4, 3000) and not sinks.validate_size(back, 4, 2999)


def test_discovery(spark, tmp_path):
    for folder in ("ep_240102_100000", "ep_240101_100000", "day10", "day2", "old_IGNORE_me"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "amplifier.dat").write_bytes(b"\0" * 16)
        (tmp_path / folder / "continuous.dat").write_bytes(b"\0" * 8)
    found = rc.discover_sessions(rc.list_files(spark, str(tmp_path), "*.dat"), ["ignore"]).orderBy("order").collect()
    assert [r.folder.rsplit("/", 1)[-1] for r in found] == ["ep_240101_100000", "ep_240102_100000", "day2", "day10"]
    assert all(r.path.endswith("amplifier.dat") and r.length == 16 for r in found)
    assert rc.check_permutation([1, 0], 2) == [1, 0]
    with pytest.raises(ValueError):
        rc.check_permutation([1, 1], 2)


def test_metadata(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<p><acquisitionSystem><nChannels>4</nChannels><samplingRate>20000</samplingRate></acquisitionSystem><fieldPotentials><lfpSamplingRate>1250</lfpSamplingRate></fieldPotentials><anatomicalDescription><channelGroups><group><channel skip='0'>0</channel><channel skip='1'>1</channel></group><group><channel>2</channel><channel>3</channel></group></channelGroups></anatomicalDescription></p>")
    row = rc.session_xml(spark, str(tmp_path / "s.xml")).first()
    assert (row.n_channels, row.rate, row.lfp_rate, row.groups, row.skipped) == (4, 20000.0, 1250.0, [[0, 1], [2, 3]], [1])
    (tmp_path / "structure.oebin").write_text(json.dumps({"continuous": [{"folder_name": "a/", "sample_rate": 30000, "num_channels": 3}, {"folder_name": "b/", "sample_rate": 1, "num_channels": 1}]}, indent=1))
    row = rc.stream_info(spark, str(tmp_path / "structure.oebin")).first()
    assert (row.folder, row.rate, row.n_channels) == ("a/", 30000.0, 3)


def test_acquisition_header(spark, tmp_path):
    text = lambda s: struct.pack("<I", 2 * len(s)) + s.encode("utf-16-le")
    raw = struct.pack("<Ihhf", rc.HEADER_MAGIC, 2, 0, 20000.0) + struct.pack("<h", 1) + struct.pack("<6f", *range(6)) + struct.pack("<h", 0) + struct.pack("<2f", 1, 2)
    raw += text("a") + text("") + struct.pack("<I", 0xFFFFFFFF) + struct.pack("<hh", 0, 0) + text("ref")
    channel = lambda kind, on: text("A-000") + text("x") + struct.pack("<10h", 0, 0, kind, on, 0, 0, 0, 0, 0, 0) + struct.pack("<2f", 0, 0)
    raw += struct.pack("<h", 1) + text("Port A") + text("A") + struct.pack("<3h", 1, 4, 2) + channel(0, 1) + channel(0, 1) + channel(0, 0) + channel(1, 1)
    (tmp_path / "info.rhd").write_bytes(raw)
    assert {r.signal_type: r.n for r in rc.acquisition_header(spark, str(tmp_path / "info.rhd")).collect()} == {"amplifier": 2, "auxiliary": 1, "supply": 0, "adc": 0, "digital_in": 0, "digital_out": 0}
    with pytest.raises(ValueError):
        rc.header_channels(b"\0" * 40)


def test_tracking_and_sorter_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("scorer,m,m,m\nbodyparts,nose,nose,nose\ncoords,x,y,likelihood\n0,1.5,2.5,0.9\n1,bad,3.5,0.1\n")
    assert [tuple(r) for r in rc.tracked_points(spark, str(tmp_path / "t.csv")).orderBy("frame").collect()] == [(0, "nose", 1.5, 2.5, 0.9), (1, "nose", None, 3.5, 0.1)]
    np.save(tmp_path / "spike_times.npy", np.array([3, 5, 9]))
    np.save(tmp_path / "spike_clusters.npy", np.array([1, 1, 2]))
    assert [tuple(r) for r in rc.sorted_spikes(spark, str(tmp_path)).orderBy("sample").collect()] == [(1, 3), (1, 5), (2, 9)]
    df = spark.createDataFrame([(1, "good", 2.0), (2, "noise", 1.0)], "cluster_id long, group string, firing_rate double")
    sinks.write_tsv(df.coalesce(1), str(tmp_path / "tsv"))
    back = rc.cluster_table(spark, str(tmp_path / "tsv"))
    assert back.columns == ["cluster_id", "group"]
    assert rc.spikes_with_labels(rc.sorted_spikes(spark, str(tmp_path)), back, ["good"]).count() == 2
    assert json.loads(sinks.manifest(spark.createDataFrame([("b", [1]), ("a", [0])], "name string, channels array<int>"), "probe"))["partitions"][0] == {"name": "a", "channels": [0]}


def streamed(spark, df, tmp_path, n=3):
    rows = df.collect()
    for i in range(n):
        spark.createDataFrame(rows[i * len(rows) // n : (i + 1) * len(rows) // n], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def collected(spark, out, mode, name, tmp_path):
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_dead_time_stream_equals_batch(spark, tmp_path):
    from tidelane.operators.sequences import greedy_thin

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("ch"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).orderBy("t").coalesce(1)
    got = collected(spark, se.dead_time(streamed(spark, e, tmp_path), "ch", "t", 7_200_000_000), "append", "dead", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted((r.ch, r.t) for r in greedy_thin(e, ["ch"], "t", 7_200_000_000, 86_400_000_000).select("ch", "t").collect())


def test_windows_and_last_values(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("ch"), F.col("ts").cast("timestamp").alias("ts"), "value").orderBy("ts").coalesce(1)
    stream = streamed(spark, e, tmp_path)
    n = collected(spark, se.windowed_counts(stream, "ts", ["ch"], "1 day"), "complete", "win", tmp_path)
    assert n.agg(F.sum("n")).first()[0] == e.count()
    last = collected(spark, se.last_values(stream, "ch", "ts", ["value"]), "complete", "last_values", tmp_path)
    want = {r.ch: r.v for r in e.groupBy("ch").agg(F.max_by("value", "ts").alias("v")).collect()}
    assert {r.ch: r.last.value for r in last.collect()} == want
    s = collected(spark, se.session_counts(stream, "ts", ["ch"], "2 hours"), "append", "sess", tmp_path)
    assert s.count() > 0


def test_windowed_reads_and_tasks(spark, tmp_path):
    x = np.arange(9_000, dtype="<i2").reshape(-1, 3)
    (tmp_path / "amplifier.dat").write_bytes(x.tobytes())
    path = str(tmp_path / "amplifier.dat")
    for start, stop in ((0, 3000), (950, 2105), (2999, None), (100, 100)):
        got = rc.samples(rc.frames(spark, path, 3, block=100, start=start, stop=stop), 3, [2]).orderBy("s").collect()
        assert [(r.s, r.v) for r in got] == [(s, float(x[s, 2])) for s in range(start, stop or 3000)]
    reader = rc.FrameReader({"path": path, "size": "6", "block": "100", "total": "3000", "bytes": "1200"})
    assert [(p.first, p.n) for p in reader.partitions()] == [(a, 200) for a in range(0, 3000, 200)]
    (tmp_path / "empty.dat").write_bytes(b"")
    with pytest.raises(ValueError):
        rc.frames(spark, str(tmp_path / "empty.dat"), 3)
