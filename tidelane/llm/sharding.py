"""Shards of near-equal bytes by histogram sort.

Rows have 63-bit keys: 31 bits of the text's hash, then 32 bits of the row's. The driver proposes boundaries, every
partition counts the bytes below each, and the intervals that hold a wanted boundary are probed again until each
boundary is within tolerance or one key wide. What the driver sees is one number a probe. Then rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

SHARDS = 40
#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Error of a boundary, in shares of a shard, at which refining stops.
TOLERANCE = 0.001
#: Error up to which a boundary moves to the border between two texts, so that equal texts share a shard.
TOGETHER = 0.01
#: New probes for each open boundary in a round.
PROBES = 64
#: Rows are numbered independently in parts of a shard: this many a shard at least, and more where a part would hold more than PART_ROWS rows.
PARTS = 64
PART_ROWS = 1_000_000
_TOP = 1 << 63


def _count(batches, probes) -> Iterator[pa.RecordBatch]:
    """Bytes and rows between neighbouring probes, of this partition."""
    points = probes.value
    size, rows = np.zeros(len(points) + 1, dtype=np.int64), np.zeros(len(points) + 1, dtype=np.int64)
    for batch in batches:
        at = np.searchsorted(points, batch.column(0).to_numpy(), side="right")
        np.add.at(size, at, batch.column(1).to_numpy())
        rows += np.bincount(at, minlength=len(rows))
    some = np.flatnonzero(rows)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], ["at", "bytes", "n"])


def _histogram(rows: DataFrame, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows in each interval between sorted points: a key equal to a point counts above it."""
    shared = rows.sparkSession.sparkContext.broadcast(points)  # at most SHARDS x PROBES numbers
    counted = rows.select("key", "size").mapInArrow(partial(_count, probes=shared), "at long, bytes long, n long").groupBy("at").agg(F.sum("bytes"), F.sum("n"))
    size, n = np.zeros(len(points) + 1, dtype=np.int64), np.zeros(len(points) + 1, dtype=np.int64)
    for at, b, k in counted.collect():  # one row a probe
        size[at], n[at] = b, k
    return size, n


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, together: float = TOGETHER) -> np.ndarray:
    """Ascending keys; shard i takes keys from splitter i - 1 on and below splitter i. rows: key (0 to 2**63 - 1), size."""
    size, _ = _histogram(rows, np.array([], dtype=np.int64))
    total = int(size.sum())
    want = [total * i // shards for i in range(1, shards)]
    allowed = tolerance * total / shards
    lo, hi = [0] * len(want), [_TOP] * len(want)  # keys with less than, and at least, the wanted bytes below
    below = {0: 0, _TOP: total}
    best = lambda i: min((lo[i], hi[i]), key=lambda k: (abs(below[k] - want[i]), k))
    while opened := [i for i in range(len(want)) if hi[i] - lo[i] > 1 and abs(below[best(i)] - want[i]) > allowed]:
        points = sorted({p for i in opened for p in (lo[i] + (hi[i] - lo[i]) * j // (PROBES + 1) for j in range(1, PROBES + 1)) if lo[i] < p < hi[i]})
        size, _ = _histogram(rows, np.array(points, dtype=np.int64))
        for p, b in zip(points, np.cumsum(size)[:-1].tolist(), strict=True):
            below[p] = b
            for i in opened:
                if b < want[i] and p > lo[i]:
                    lo[i] = p
                elif b >= want[i] and p < hi[i]:
                    hi[i] = p
    cuts = [best(i) for i in range(len(want))]
    # borders between texts next to the cuts
    edges = [((c >> 32) << 32, min(((c + (1 << 32) - 1) >> 32) << 32, _TOP - 1)) for c in cuts]
    points = sorted({p for pair in edges for p in pair})
    size, _ = _histogram(rows, np.array(points, dtype=np.int64))
    below |= dict(zip(points, np.cumsum(size)[:-1].tolist(), strict=True))
    for i, pair in enumerate(edges):
        near = min(pair, key=lambda k: abs(below[k] - want[i]))
        if abs(below[near] - want[i]) <= max(together * total / shards, abs(below[cuts[i]] - want[i])):
            cuts[i] = near
    return np.minimum(np.maximum.accumulate(np.array(cuts, dtype=np.uint64)), np.uint64(_TOP - 1)).astype(np.int64)


def part_bounds(rows: DataFrame, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the parts of all shards, cuts among them, and rows of each part.

    A part with more than twice the rows of an even part is divided again, until it holds one key only: a text with a third of all
    rows gets its share of parts.
    """
    ends = [0, *cuts.tolist(), _TOP]
    bounds = sorted({a + (b - a) * j // PARTS for a, b in zip(ends[:-1], ends[1:], strict=True) for j in range(PARTS)} - {0})
    while True:
        _, n = _histogram(rows, np.array(bounds, dtype=np.int64))
        even = min(max(int(n.sum()) // (len(cuts) + 1) // PARTS, 1), PART_ROWS)
        edges = [0, *bounds, _TOP]
        heavy = [i for i in np.flatnonzero(n > 2 * even).tolist() if edges[i + 1] - edges[i] > 1]
        more = {edges[i] + (edges[i + 1] - edges[i]) * j // PROBES for i in heavy for j in range(1, PROBES)} - {edges[i] for i in heavy}
        if not more:
            return np.array(bounds, dtype=np.int64), n
        bounds = sorted({*bounds, *more})


def _deal(batches, bounds, base, shard) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.searchsorted(bounds.value, batch.column("key").to_numpy(), side="right")
        cells = [*batch.columns, pa.array(shard.value[at]), pa.array(at), pa.array(base.value[at])]
        yield pa.RecordBatch.from_arrays(cells, [*batch.schema.names, "shard", "_part", "_base"])


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null): a row for each row of docs.

    Shards hold nearly equal bytes (size: UTF-8 bytes, none for null, and ROW_BYTES). Equal texts lie side by side in key
    order and share a shard unless a boundary must fall among them to keep sizes near equal. Rows that agree in id and
    text have equal keys, and one shard. Slots run from 0 without gaps. Null and repeated ids are fine, other columns aren't
    read, and an empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    high = F.shiftrightunsigned(F.xxhash64(F.lit(7), text), 33)
    low = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(id_col).cast("string"), text), 32)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.shiftleft(high, 32) + low).alias("key"),
    )
    rows = stage.write(rows, "rows", scan=True)
    cuts = splitters(rows, shards)
    # the parts' counts give every part's first slot
    bounds, n = part_bounds(rows, cuts)
    of = np.searchsorted(cuts, np.append(0, bounds), side="right")
    before = np.cumsum(n) - n
    base = before - before[np.searchsorted(of, of)]
    context = docs.sparkSession.sparkContext
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.mapInArrow(partial(_deal, bounds=context.broadcast(bounds), base=context.broadcast(base), shard=context.broadcast(of.astype(np.int32))), schema + ", shard int, _part long, _base long")
    slot = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("key", "doc_id")) - 1 + F.col("_base")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
