"""Correlograms of all pairs of units, counted where they are used: neither pairs nor copies of spikes are exchanged."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import checkpointed

#: Tasks of a pass, rows of a batch that leaves it, and pairs per spike of the other side from which a unit's pairs are counted by searches instead.
TASKS, BATCH_ROWS, SCAN = 96, 1 << 16, 600


def lag_edges(bin_width, n_bins: int, whole: bool) -> list[tuple[float, bool]]:
    """Where bins -n_bins to n_bins of rounded lags begin, and where the last ends: (lag, whether that lag itself lies beyond). Halves round to even bins; the last bin is open at its end."""
    edges = [((k - 0.5) * bin_width, k % 2 == 0 or k > n_bins) for k in range(-n_bins, n_bins + 2)]
    return [(math.ceil(v) if with_it else math.floor(v), with_it) for v, with_it in edges] if whole else edges


class Train:
    """A unit's spikes x among all spikes y of the other side: its counts by bin with everyone, with itself, and with each unit."""

    def __init__(self, code: int, x, y, p, n: int, edges):
        self.code, self.x, self.y, self.p, self.n, self.edges = code, x, y, p, n, edges
        self.ends = [np.searchsorted(y, x + v, "left" if with_it else "right") for v, with_it in edges]

    def everyone(self):
        return np.diff([int(e.sum()) for e in self.ends])

    def itself(self):
        return np.diff([int(np.searchsorted(self.x, self.x + v, "left" if with_it else "right").sum()) for v, with_it in self.edges])

    def others(self):
        """Units that it meets, itself among them, and the counts, a row a bin."""
        bins, p, ends = len(self.edges) - 1, self.p, self.ends
        n = np.zeros((bins, self.n), dtype=np.int64)
        if int((ends[-1] - ends[0]).sum()) <= SCAN * len(self.y):
            ends = [e.tolist() for e in ends]
            for k in range(bins):
                near = [p[i:j] for i, j in zip(ends[k], ends[k + 1], strict=True) if i < j]
                if near:
                    n[k] = np.bincount(np.concatenate(near), minlength=self.n)
        else:  # a unit of very many spikes
            beyond = lambda v, with_it: np.searchsorted(self.x, self.y - v, "right" if with_it else "left")
            last = beyond(*self.edges[0])
            for k in range(bins):
                this, last = last, beyond(*self.edges[k + 1])
                n[k] = np.bincount(p, weights=this - last, minlength=self.n)
        hit = np.flatnonzero(n.any(axis=0))
        return hit, n if len(hit) == self.n else n[:, hit]


class Meetings:
    """All pairs of units of a and b (a itself if None) whose spikes come within bins -n_bins to n_bins of rounded lags b - a.

    Pairs may be as many as the square of the units, so none is kept: a pass counts them anew, unit by unit, in arrays. Spikes are stored once, and each task of a
    pass reads all of them (12 bytes each) for its share of a's units; nothing is exchanged. The driver holds a few numbers a unit. Null is a unit of its own.
    """

    def __init__(self, a: DataFrame, t: str, bin_width, n_bins: int, b: DataFrame | None = None):
        import pyarrow as pa
        import pyarrow.compute as pc

        self.spark, self.two, self.n_bins, self.kind = a.sparkSession, b is not None, n_bins, a.schema["unit"].dataType.simpleString()
        rows = a.select("unit", F.col(t).alias("_t"), F.lit(0).alias("_b"))
        rows = rows if b is None else rows.union(b.select("unit", F.col(t).alias("_t"), F.lit(1).alias("_b")))
        sized = rows.groupBy("unit").agg(F.sum(1 - F.col("_b")).alias("n")).toArrow()
        self.units, self.total = sized.column("unit").combine_chunks(), sized.column("n").to_numpy()
        time = rows.schema["_t"].dataType.simpleString()
        self.edges = lag_edges(bin_width, n_bins, time in ("tinyint", "smallint", "int", "bigint"))
        names = self.units

        def pack(batches):
            for batch in batches:
                if batch.num_rows:
                    u = pc.add(pc.index_in(batch.column("unit"), value_set=names), pc.multiply(batch.column("_b"), pa.scalar(len(names), pa.int32())))
                    ends = pa.array([0, len(u)], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, batch.column("_t")), pa.ListArray.from_arrays(ends, u)], names=["_t", "_u"])

        self.pieces = checkpointed(rows.filter("_t IS NOT NULL").mapInArrow(pack, f"_t array<{time}>, _u array<int>")).coalesce(1)

    def run(self, each, columns: str, paired: bool = True) -> DataFrame:
        """unit, other and what `each` makes of a unit's Train: the others' codes and a list of Arrow arrays (paired=False: unit and those, a row or none a unit). Codes are places in self.units."""
        import pyarrow as pa

        units, total, edges, two, n = self.units, self.total, self.edges, self.two, len(self.units)
        tasks = min(TASKS, max(1, -(-n // 32)))
        share = (np.cumsum(total) - 1).clip(0) * tasks // max(int(total.sum()), 1)  # even shares of the spikes
        first = ["unit", "other"][: 1 + paired]
        schema = ", ".join([*[f"{c} {self.kind}" for c in first], *([columns] if columns else [])])
        names = [*first, *[c.split(" ")[0] for c in columns.split(", ") if c]]

        def sweep(batches):
            task, at, u = None, [], []
            for batch in batches:
                if batch.num_rows:
                    task = batch.column("id")[0].as_py()
                    at.append(batch.column("_t").flatten().to_numpy())
                    u.append(batch.column("_u").flatten().to_numpy())
            if not at:
                return
            at, u = np.concatenate(at), np.concatenate(u)
            of_b = u >= n if two else np.ones(len(u), dtype=bool)
            own = np.flatnonzero(share[u % n] == task)
            own = own[u[own] < n]
            if not len(own):
                return
            order = np.lexsort((at[own], u[own]))
            x, c = at[own][order], u[own][order]
            y, p = at[of_b], u[of_b] % n
            order = np.argsort(y, kind="stable")
            y, p = y[order], p[order]
            del at, u, of_b, own, order
            starts = np.flatnonzero(np.diff(c, prepend=-1))
            ready, size = [], 0
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(c)], strict=True):
                codes, arrays = each(Train(int(c[s]), x[s:e], y, p, n, edges))
                if len(codes):
                    own_names = [units.take(pa.array(np.full(len(codes), c[s]))), *([units.take(pa.array(codes))] if paired else [])]
                    ready.append(pa.RecordBatch.from_arrays([*own_names, *arrays], names=names))
                    size += len(codes)
                if size >= BATCH_ROWS // 4:
                    yield from pa.Table.from_batches(ready).combine_chunks().to_batches(BATCH_ROWS)
                    ready, size = [], 0
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches(BATCH_ROWS)

        shares = self.spark.range(0, tasks, 1, tasks).hint("shuffle_replicate_nl")  # a task for each share reads the stored pieces; none is copied
        return shares.crossJoin(self.pieces).mapInArrow(sweep, schema)


def half_up(x, digits: int | None):
    """x rounded as SQL does: halves go away from zero."""
    return x if digits is None else np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


def erf(x):
    """The error function to 1.5e-7 by a rational approximation."""
    a = np.abs(x)
    u = 1 / (1 + 0.3275911 * a)
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-a * a))


def metrics(n, n_bins: int, far: tuple[int, int], near: tuple[int, int], centres: int):
    """units.correlogram_metrics() of counts with a row a bin: r (NaN if unknown) and q."""
    over = lambda bins, size: sum((n[k + n_bins] for k in bins if abs(k) <= n_bins), np.zeros(n.shape[1], dtype=np.int64)) / size
    (f0, f1), (n0, n1) = far, near
    s = np.maximum(np.maximum(over([*range(f0, f1), *range(1 - f1, -f0)], 2 * (f1 - f0) - 1), over(range(n0, n1), n1 - n0)), over(range(-n1, -n0), n1 - n0))
    c = [over([k for k in range(-i, i + 1) if k], 1.0) for i in range(1, centres + 1)]
    r = np.minimum.reduce([c[i - 1] / (2 * i) for i in range(1, centres + 1)]) / np.where(s > 0, s, np.nan)
    q = np.minimum.reduce([0.5 * (1 + erf((c[i - 1] / 2 - s * i) / np.sqrt(1e-10 + 2 * (s * i)))) for i in range(1, centres + 1)])
    return r, q
