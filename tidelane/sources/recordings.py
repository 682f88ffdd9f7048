"""Sources: raw interleaved recordings, listings of sessions, sidecar metadata, tables of tracked points, arrays.

Everything is read through Spark, so paths may lie in any store that Spark reads.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import folder_time, natural_key


def list_files(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """path, length of files under base; the contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base).select("path", "length")


def discover_sessions(files: DataFrame, ignore: list[str], names: tuple[str, ...] = ("amplifier.dat", "continuous.dat")) -> DataFrame:
    """O-SRC-01: folder, path, length, order of the epoch recordings, one a folder (the first of `names`), dated folders first by time, then by natural order.

    Folders that contain an ignored text (in any case) are left out.
    """
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", r"/[^/]*$", "")
    rank = F.array_position(F.array(*map(F.lit, names)), name)
    rows = files.withColumn("folder", folder).filter(name.isin(*names)).withColumn("_rank", rank)
    for text in ignore:
        rows = rows.filter(~F.contains(F.lower("folder"), F.lit(text.lower())))
    best = rows.groupBy("folder").agg(F.min_by(F.struct("path", "length"), "_rank").alias("_f")).select("folder", "_f.*")
    last = F.element_at(F.split("folder", "/"), -1)
    return best.select("*", F.struct(F.when(folder_time(last).isNull(), 1).otherwise(0).alias("rank"), folder_time(last).alias("time"), natural_key(last).alias("name")).alias("order"))


def check_permutation(order: list[int], n: int) -> list[int]:
    """O-SRC-04: a 0-based permutation of n, or an error."""
    if sorted(order) != list(range(n)):
        raise ValueError("the order must name every recording once")
    return order


class _Range(InputPartition):
    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class FrameReader(DataSourceReader):
    """Reads byte ranges of one raw file; each range is a task that can run again anywhere."""

    def __init__(self, options):
        self.path, self.size, self.block, self.total = options["path"], int(options["size"]), int(options["block"]), int(options["total"])
        self.task = max(1, int(options.get("bytes", 64 << 20)) // (self.size * self.block)) * self.block

    def partitions(self):
        return [_Range(a, min(self.task, self.total - a)) for a in range(0, self.total, self.task)] or [_Range(0, 0)]

    def read(self, partition):
        import pyarrow.fs

        store, at = pyarrow.fs.FileSystem.from_uri(self.path)
        with store.open_input_file(at) as file:
            for a in range(partition.first, partition.first + partition.n, self.block):
                n = min(self.block, partition.first + partition.n - a)
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([n], pa.int32()), pa.array([file.read_at(n * self.size, a * self.size)], pa.binary())], ["first", "n", "data"])


class FrameSource(DataSource):
    """The format behind frames()."""

    @classmethod
    def name(cls):
        return "tidelane_frames"

    def schema(self):
        return "first long, n int, data binary"

    def reader(self, schema):
        return FrameReader(self.options)


def frames(spark: SparkSession, path: str, n_channels: int, dtype: str = "<i2", block: int = 1024, start: int = 0, stop: int | None = None) -> DataFrame:
    """O-SRC-05/06/23/26: first (sample number), n, data (n x n_channels numbers, interleaved) of a raw recording, or of its samples from start to stop.

    A file is read by byte ranges, `block` frames a row and about 64 MB a task; one whose size isn't a multiple of a frame is an error.
    """
    size = n_channels * np.dtype(dtype).itemsize
    found = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # one file
    if len(found) != 1 or found[0].length % size:
        raise ValueError("one file is wanted whose size is a multiple of a frame")
    total, uri = found[0].length // size, found[0].path
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    spark.dataSource.register(FrameSource)
    rows = spark.read.format("tidelane_frames").options(path=uri, size=str(size), block=str(block), total=str(total)).load()
    if start or stop is not None:
        stop = total if stop is None else min(stop, total)
        rows = rows.filter((F.col("first") < stop) & (F.col("first") + F.col("n") > start))
        skip = F.greatest(F.lit(start) - F.col("first"), F.lit(0))
        kept = F.least(F.lit(stop), F.col("first") + F.col("n")) - F.col("first") - skip
        rows = rows.select((F.col("first") + skip).alias("first"), kept.cast("int").alias("n"), F.substring("data", (skip * size + 1).cast("int"), (kept * size).cast("int")).alias("data"))
    return rows


def samples(blocks: DataFrame, n_channels: int, channels: list[int] | None = None, dtype: str = "<i2", gain: float = 1.0, offset: float = 0.0) -> DataFrame:
    """O-SRC-07/08: ch, s, v of blocks; only the wanted channels leave the Arrow batch."""
    wanted = sorted(set(range(n_channels) if channels is None else channels))
    if wanted and not 0 <= wanted[0] <= wanted[-1] < n_channels:
        raise ValueError("a channel is out of range")

    def spread(batches):
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, dtype=dtype).reshape(-1, n_channels)
                for c in wanted:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(np.arange(first, first + len(x), dtype=np.int64)), pa.array(x[:, c].astype(np.float64) * gain + offset)], ["ch", "s", "v"])

    return blocks.select("first", "data").mapInArrow(spread, "ch int, s long, v double")


def session_xml(spark: SparkSession, path: str) -> DataFrame:
    """O-SRC-12/13: one row: n_channels, rate, lfp_rate, groups (arrays of channels), skipped, from a session's XML."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(spark.read.text(path, wholetext=True).first()[0])
    number = lambda tag, default: next((float(e.text) for e in root.iter(tag) if e.text and e.text.strip()), default)
    groups, skipped = [], set()
    for g in root.iterfind("anatomicalDescription/channelGroups/group"):
        groups.append([int(c.text) for c in g.iter("channel")])
        skipped |= {int(c.text) for c in g.iter("channel") if c.get("skip") == "1"}
    n = number("nChannels", float(sum(map(len, groups))))
    row = (int(n), number("samplingRate", number("sampleRate", None)), number("lfpSamplingRate", None), groups, sorted(skipped))
    return spark.createDataFrame([row], "n_channels int, rate double, lfp_rate double, groups array<array<int>>, skipped array<int>")


def stream_info(spark: SparkSession, path: str) -> DataFrame:
    """O-SRC-09: folder, rate, n_channels of the first continuous stream in a JSON descriptor."""
    first = spark.read.json(path, multiLine=True).select(F.element_at("continuous", 1).alias("c"))
    return first.select(F.col("c.folder_name").alias("folder"), F.col("c.sample_rate").cast("double").alias("rate"), F.col("c.num_channels").cast("int").alias("n_channels"))


#: How a header of the format begins, and its signal types by number.
HEADER_MAGIC = 0xC6912702
SIGNAL_TYPES = ("amplifier", "auxiliary", "supply", "adc", "digital_in", "digital_out")


def header_channels(raw: bytes) -> dict:
    """O-SRC-14: version, rate and enabled channels by signal type of a binary acquisition header."""
    at = 0

    def take(form: str):
        nonlocal at
        out = struct.unpack_from("<" + form, raw, at)
        at += struct.calcsize("<" + form)
        return out if len(out) > 1 else out[0]

    def text() -> str:
        nonlocal at
        size = take("I")
        if size == 0xFFFFFFFF:
            return ""
        at += size
        return raw[at - size : at].decode("utf-16-le")

    if take("I") != HEADER_MAGIC:
        raise ValueError("not an acquisition header")
    major, minor = take("hh")
    rate = take("f")
    take("h")
    for _ in range(6):
        take("f")
    take("h")
    take("ff")
    notes = [text() for _ in range(3)]
    version = (major, minor)
    if version >= (1, 1):
        take("h")
    if version >= (1, 3):
        take("h")
    reference = text() if version >= (2, 0) else ""
    counts = dict.fromkeys(SIGNAL_TYPES, 0)
    for _ in range(take("h")):
        text(), text()
        enabled, n, _ = take("hhh")
        for _ in range(n if enabled or n else 0):
            text(), text()
            _, _, kind, on = take("hhhh")
            take("hh")
            take("hhhh")
            take("ff")
            if on:
                counts[SIGNAL_TYPES[kind]] += 1
    block = 60 if major == 1 else 128
    return {"version": version, "rate": rate, "aux_rate": rate / 4, "supply_rate": rate / block, "notes": notes, "reference": reference, "channels": counts}


def acquisition_header(spark: SparkSession, path: str) -> DataFrame:
    """signal_type, n of enabled channels, rate."""
    found = header_channels(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    return spark.createDataFrame([(k, n, float(found["rate"])) for k, n in found["channels"].items()], "signal_type string, n int, rate double")


def tracked_points(spark: SparkSession, path: str) -> DataFrame:
    """O-SRC-17/18, O-SUP-17: frame, point, x, y, likelihood of a tracking CSV with any number of header rows; text that isn't a number is null.

    The header is the lines before the first whose second field is a number; the last of them that names coordinates says which column is which, the one above it the point.
    """
    lines = [r[0] for r in spark.read.text(path).limit(51).collect()]
    fields = [x.split(",") for x in lines]
    isnum = lambda x: x.strip().lstrip("-").replace(".", "", 1).isdigit()
    top = next((i for i, f in enumerate(fields) if len(f) > 1 and isnum(f[0]) and any(map(isnum, f[1:]))), None)
    if not top:
        raise ValueError("no header and data found")
    coords = next(i for i in range(top - 1, -1, -1) if sum(c.strip().rsplit("_", 1)[-1] in ("x", "y", "likelihood") for c in fields[i]) >= 2)
    names = []
    for j, c in enumerate(fields[coords]):
        head, _, part = c.strip().rpartition("_")
        names.append((head or (fields[coords - 1][j].strip() if coords else ""), part or c.strip()))
    raw = spark.read.text(path).withColumn("_f", F.split("value", ",")).filter(F.get("_f", F.lit(0)).try_cast("double").isNotNull())
    num = lambda j: F.get("_f", F.lit(j)).try_cast("double")
    points = list(dict.fromkeys(n for n, p in names if p in ("x", "y", "likelihood")))
    at = {(n, p): j for j, (n, p) in enumerate(names)}
    one = [F.struct(F.lit(p).alias("point"), *[(num(at[p, c]) if (p, c) in at else F.lit(None).cast("double")).alias(c) for c in ("x", "y", "likelihood")]) for p in points]
    return raw.select(num(0).cast("long").alias("frame"), F.explode(F.array(*one)).alias("p")).select("frame", "p.*")


def read_npy(spark: SparkSession, path: str) -> np.ndarray:
    """O-SRC-21: an array file, read whole on the driver (sorter outputs of small size, such as templates)."""
    import io

    return np.load(io.BytesIO(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])), allow_pickle=False)


def sorted_spikes(spark: SparkSession, folder: str) -> DataFrame:
    """O-SRC-21: unit, sample of a sorter's spike_times.npy and spike_clusters.npy, left out if their lengths differ."""
    t, c = read_npy(spark, f"{folder}/spike_times.npy").ravel(), read_npy(spark, f"{folder}/spike_clusters.npy").ravel()
    if len(t) != len(c):
        raise ValueError("spike times and clusters differ in length")
    return spark.createDataFrame(pa.table({"unit": c.astype(np.int64), "sample": t.astype(np.int64)}))


def cluster_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with header and inferred types."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def spikes_with_labels(spikes: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Spikes of units whose group is one of `keep`."""
    return spikes.join(labels.filter(F.col("group").isin(keep)).select(F.col("cluster_id").alias("unit")), "unit", "left_semi")
