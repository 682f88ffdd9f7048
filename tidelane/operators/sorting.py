"""Spike-sorting operators: snippets, template grids, drift bins, features, graph clustering, positions, comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import checkpointed


def isolated_peaks(samples: DataFrame, contacts: DataFrame, s: str, value: str, threshold: float, reach_s: int, reach_um: float) -> DataFrame:
    """O-SRT-01: samples above the threshold that are the strict maximum among channels within reach_um and samples within reach_s (ties: the lower channel, then the earlier sample)."""
    hot = samples.filter(F.col(value) > threshold).select("ch", s, value)
    a, b = contacts.select("ch", "x", "y"), contacts.select(F.col("ch").alias("_ch"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    near = a.join(b, F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) <= reach_um).select("ch", "_ch")  # contacts: a bounded table
    other = hot.select(F.col("ch").alias("_ch"), F.col(s).alias("_s"), F.col(value).alias("_v"))
    size = max(reach_s, 1)
    placed = hot.withColumn("_k", F.explode(F.array(*[F.floor(F.col(s) / size) + d for d in (-1, 0, 1)]))).join(F.broadcast(near), "ch")
    met = placed.join(other.withColumn("_k", F.floor(F.col("_s") / size)), ["_ch", "_k"]).filter(F.abs(F.col(s) - F.col("_s")) <= reach_s)
    beats = (F.col("_v") > F.col(value)) | ((F.col("_v") == F.col(value)) & ((F.col("_ch") < F.col("ch")) | ((F.col("_ch") == F.col("ch")) & (F.col("_s") < F.col(s)))))
    return hot.join(met.filter(beats).select("ch", s).distinct(), ["ch", s], "left_anti")


def template_grid(contacts: DataFrame, step_x: float, step_y: float) -> DataFrame:
    """O-SRT-03: x, y of a grid over the contacts' extent."""
    e = contacts.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    axis = lambda lo, hi, step: F.transform(F.sequence(F.lit(0), F.floor((F.col(hi) - F.col(lo)) / step).cast("int")), lambda i: F.col(lo) + i * step)
    return e.select(F.explode(axis("a", "b", step_x)).alias("x"), "c", "d").select("x", F.explode(axis("c", "d", step_y)).alias("y"))


def drift_bins(spikes: DataFrame, t: str, depth: str, amplitude: str, batch, bin_um: float, bins: int = 20, low: float = 1.0, high: float = 2.0) -> DataFrame:
    """O-SRT-06: batch, depth_bin, amplitude_bin, weight = log2(1 + n): log10 amplitudes clipped to low..high in `bins` bins."""
    a = (F.least(F.greatest(F.log10(amplitude), F.lit(low)), F.lit(high)) - low) / (high - low)
    rows = spikes.filter(F.col(amplitude) > 0).groupBy(F.floor(F.col(t) / batch).alias("batch"), F.floor(F.col(depth) / bin_um).cast("long").alias("depth_bin"), F.least(F.floor(a * bins), F.lit(bins - 1)).cast("long").alias("amplitude_bin"))
    return rows.agg(F.log2(1 + F.count(F.lit(1))).alias("weight"))


def drift_shifts(binned: DataFrame, reach: int) -> DataFrame:
    """O-SRT-27: batch, shift (in depth bins, up to reach) with the greatest product sum against the mean over batches, in one pass; ties go to the smallest shift. aligned_shifts() repeats it."""
    n = binned.select(F.count_distinct("batch").alias("_b"))
    mean = binned.groupBy("depth_bin", "amplitude_bin").agg(F.sum("weight").alias("_t")).crossJoin(F.broadcast(n)).withColumn("_t", F.col("_t") / F.col("_b")).drop("_b")  # n has one row
    moved = binned.withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("depth_bin", F.col("depth_bin") + F.col("shift"))
    scored = moved.join(mean, ["depth_bin", "amplitude_bin"]).groupBy("batch", "shift").agg(F.sum(F.col("weight") * F.col("_t")).alias("_s"))
    return scored.groupBy("batch").agg(F.max_by("shift", F.struct(F.round("_s", 9), -F.abs("shift"), -F.col("shift"))).alias("shift"))


def aligned_shifts(binned: DataFrame, depth_bins: int, amplitude_bins: int, blocks: int, rounds: int = 10, reach: int = 15, fine_reach: int = 5, smoothing: float = 0.5, first: int = 300) -> DataFrame:
    """O-SRT-07/08: batch, block, shift: the vertical shift of each batch of drift_bins() in depth bins, for overlapping depth blocks.

    Fingerprints lose their mean over depth. In each round but the last every batch rolls by the whole shift (up to reach) that fits the template
    best, and the template becomes the mean of the rolled ones; the first is batch number min(first, half of them). Then each of the 2 * blocks - 1 half-overlapping
    blocks of depth is fitted alone up to fine_reach, its scores smoothed over shifts, batches and blocks and read between bins in tenths.
    A batch is one row of depth_bins x amplitude_bins numbers; templates of that size are all that comes to the driver.
    """
    spark = binned.sparkSession
    kind = binned.schema["batch"].dataType.simpleString()
    shape = (depth_bins, amplitude_bins)

    def fingerprint(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.zeros(shape)
        f[pdf["depth_bin"], pdf["amplitude_bin"]] = pdf["weight"]
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "f": [(f - f.mean(axis=0)).ravel()], "total": [0.0]})

    schema = f"batch {kind}, f array<double>, total double"
    prints = checkpointed(binned.groupBy("batch").applyInPandas(fingerprint, schema))
    n = prints.count()
    if not n:
        return spark.createDataFrame([], f"batch {kind}, block int, shift double")
    template = np.array(prints.orderBy("batch").offset(min(first, n // 2)).limit(1).first().f).reshape(shape)

    def scores(f: np.ndarray, base: np.ndarray, most: int) -> np.ndarray:
        return np.round([(np.roll(f, d, axis=0) * base).mean() for d in range(-most, most + 1)], 12)

    def mean_of(frames: DataFrame) -> np.ndarray:
        def add(batches):
            total = np.zeros(depth_bins * amplitude_bins)
            for pdf in batches:
                if len(pdf):
                    total += np.stack(pdf["f"].tolist()).sum(axis=0)
            yield pd.DataFrame({"f": [total]})

        return sum(np.array(r.f) for r in frames.select("f").mapInPandas(add, "f array<double>").toLocalIterator()).reshape(shape) / n

    for _ in range(rounds - 1):
        def align(batches, base=template):
            for pdf in batches:
                moved, totals = [], []
                for f, total in zip(pdf["f"], pdf["total"], strict=True):
                    f = np.asarray(f).reshape(shape)
                    d = int(scores(f, base, reach).argmax()) - reach
                    moved.append(np.roll(f, d, axis=0).ravel())
                    totals.append(total + d)
                yield pd.DataFrame({"batch": pdf["batch"], "f": moved, "total": totals})

        prints = checkpointed(prints.mapInPandas(align, schema))
        template = mean_of(prints)
    size = depth_bins // blocks
    starts = np.round(np.linspace(0, depth_bins - size, 2 * blocks - 1)).astype(int)
    k = np.arange(-int(4 * smoothing + 0.5), int(4 * smoothing + 0.5) + 1)
    kernel = np.exp(-0.5 * (k / smoothing) ** 2) / np.exp(-0.5 * (k / smoothing) ** 2).sum() if smoothing else np.ones(1)
    k = k if smoothing else np.zeros(1, int)

    def mirrored(i: np.ndarray, m: int) -> np.ndarray:
        """Indices beyond the ends as reflected, the end itself repeated."""
        i = np.mod(i, 2 * m)
        return np.where(i < m, i, 2 * m - 1 - i)

    def along(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.shape[axis]
        return sum(w * np.take(x, mirrored(np.arange(m) + d, m), axis=axis) for w, d in zip(kernel, k, strict=True))

    def fine(batches, base=template):
        for pdf in batches:
            rows = []
            for f in pdf["f"]:
                f = np.asarray(f).reshape(shape)
                by = np.stack([scores(f[a : a + size], base[a : a + size], fine_reach) for a in starts], axis=1)
                rows.append(along(along(by, 0), 1).ravel())
            yield pd.DataFrame({"place": pdf["place"], "batch": pdf["batch"], "total": pdf["total"], "dc": rows})

    order = F.row_number().over(Window.orderBy("batch")) - 1  # a row a batch of seconds, three numbers each
    places = prints.select("batch").withColumn("place", order)
    found = checkpointed(prints.join(places, "batch").mapInPandas(fine, f"place int, batch {kind}, total double, dc array<double>"))
    copies = F.array(*[F.struct(F.lit(int(d)).alias("d"), F.lit(float(w)).alias("w")) for w, d in zip(kernel, k, strict=True)])
    near = found.select("place", "batch", "total", F.explode(copies).alias("c"))
    at = F.pmod(F.col("place") + F.col("c.d"), F.lit(2 * n))
    near = near.withColumn("_at", F.when(at < n, at).otherwise(2 * n - 1 - at)).join(found.select(F.col("place").alias("_at"), "dc"), "_at").select("batch", "total", F.col("c.w").alias("w"), "dc")
    offsets, tenths = np.arange(-fine_reach, fine_reach + 1), np.linspace(-fine_reach, fine_reach, 2 * fine_reach * 10 + 1)
    between = np.exp(-((offsets[:, None] - tenths[None, :]) ** 2) / 2)

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        dc = sum(w * np.asarray(x) for w, x in zip(pdf["w"], pdf["dc"], strict=True)).reshape(len(offsets), len(starts))
        best = np.round(between.T @ dc, 10).argmax(axis=0)
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]] * len(starts), "block": np.arange(len(starts), dtype=np.int32), "shift": pdf["total"].iloc[0] + tenths[best]})

    return near.groupBy("batch").applyInPandas(read, f"batch {kind}, block int, shift double")


def scaled_log_amplitude(spikes: DataFrame, keys: list[str], amplitude: str, out: str = "log_amplitude") -> DataFrame:
    """O-SRT-09: z-scored (population) log10 amplitude by key; 0 for constants."""
    a = F.log10(F.greatest(amplitude, F.lit(1e-10)))
    m = spikes.groupBy(*keys).agg(F.avg(a).alias("_m"), F.stddev_pop(a).alias("_s"))
    return spikes.join(m, keys).withColumn(out, F.when(F.col("_s") > 0, (a - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def energy_ratios(features: DataFrame, vector: str, width: int, n_channels: int, k: int, out: str = "ratios") -> DataFrame:
    """O-SRT-09: energies of the k channels after the strongest over its energy; vector holds `width` numbers for each of n_channels."""
    energy = F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)), lambda c: F.aggregate(F.slice(F.col(vector), c * width + 1, F.lit(width)), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = features.withColumn("_e", F.sort_array(energy, asc=False))
    return rows.withColumn(out, F.transform(F.slice("_e", 2, k), lambda e: F.when(F.col("_e")[0] > 0, e / F.col("_e")[0]).otherwise(0.0))).drop("_e")


def modularity_clusters(edges: DataFrame, rounds: int = 20, resolution: float = 1.0) -> DataFrame:
    """O-SRT-10: node, cluster by local moves on a weighted graph (src, dst, w; both directions): each round a node takes the neighbouring cluster with the highest weight towards it less resolution * degree * cluster weight / total.

    In odd rounds nodes with an odd hash move, in even rounds the others, so two neighbours don't swap for ever. Rounds end when nothing changes.
    """
    edges = checkpointed(edges.filter("src != dst"))
    degree = checkpointed(edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k")).first()[0]
    labels = degree.select("node", F.col("node").alias("cluster"))
    if not total:
        return labels
    for turn in range(rounds):
        weight = labels.join(degree, "node").groupBy("cluster").agg(F.sum("k").alias("_K"))
        towards = edges.join(labels.select(F.col("node").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("node"), "cluster").agg(F.sum("w").alias("_w"))
        own = labels.select("node", F.col("cluster").alias("_own"))
        scored = towards.join(weight, "cluster").join(degree, "node").join(own, "node")
        others = F.col("_K") - F.when(F.col("cluster") == F.col("_own"), F.col("k")).otherwise(0.0)
        scored = scored.withColumn("_g", F.round(F.col("_w") - resolution * F.col("k") * others / total, 9))
        best = scored.groupBy("node").agg(F.max_by("cluster", F.struct("_g", (F.col("cluster") == F.col("_own")), -F.col("cluster"))).alias("_best"), F.max("_g").alias("_g"))
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        new = checkpointed(labels.join(best, "node", "left").select("node", F.when(moves & (F.col("_g") > 0), F.col("_best")).otherwise(F.col("cluster")).alias("_new"), "cluster"))
        changed = new.filter("_new != cluster").limit(1).count()
        labels = new.select("node", F.col("_new").alias("cluster"))
        if not changed and turn % 2:
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """O-SRT-10/12: one row: modularity of a clustering (node, cluster) of a weighted graph given in both directions."""
    a = labels.select(F.col("node").alias("src"), F.col("cluster").alias("_a"))
    b = labels.select(F.col("node").alias("dst"), F.col("cluster").alias("_b"))
    rows = edges.filter("src != dst").join(a, "src").join(b, "dst")
    inside = rows.agg(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("w")).otherwise(0.0)).alias("_in"), F.sum("w").alias("_t"))
    square = rows.groupBy("_a").agg(F.sum("w").alias("_k")).agg(F.sum(F.col("_k") * F.col("_k")).alias("_q"))
    return inside.crossJoin(square).select((F.col("_in") / F.col("_t") - F.col("_q") / (F.col("_t") * F.col("_t"))).alias("modularity"))  # one row each


def cluster_links(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """O-SRT-12: a, b, w, ratio: weight between clusters over its expectation from their degrees."""
    a = labels.select(F.col("node").alias("src"), F.col("cluster").alias("a"))
    b = labels.select(F.col("node").alias("dst"), F.col("cluster").alias("b"))
    return link_ratios(edges.filter("src != dst").join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.sum("w").alias("w")))


def link_ratios(w: DataFrame) -> DataFrame:
    """O-SRT-12: a, b, w of cluster_links() with ratio."""
    k = w.groupBy("a").agg(F.sum("w").alias("_k"))
    total = k.agg(F.sum("_k").alias("_t"))
    rows = w.join(k, "a").join(k.select(F.col("a").alias("b"), F.col("_k").alias("_l")), "b").crossJoin(F.broadcast(total))  # one row
    return rows.select("a", "b", "w", (F.col("w") * F.col("_t") / (F.col("_k") * F.col("_l"))).alias("ratio"))


#: Tasks of a pass over units that coincide, and spikes of a piece of the axis, about.
COINCIDENCE_TASKS, PIECE_ROWS = 48, 1 << 15


class Coincidences:
    """The graph of units that coincide, without its edges: w of two units is how often spikes of one lie within `within` of the other's, [-within, within) counted from either side.

    Its edges may be as many as the square of the units, so none is kept: a pass counts them anew from the spikes, unit by unit, in arrays. Spikes are stored once, in pieces
    of the axis, and each task of a pass reads all pieces for its share of the units; nothing is exchanged but what the pass finds. The driver holds a few numbers a unit.
    """

    def __init__(self, spikes: DataFrame, t: str, within):
        import numpy as np
        import pyarrow as pa

        self.within, self.spark = within, spikes.sparkSession
        rows = spikes.filter(F.col("unit").isNotNull() & F.col(t).isNotNull()).select("unit", F.col(t).alias("_t"))
        codes = checkpointed(rows.select("unit").distinct().withColumn("_u", F.row_number().over(Window.orderBy("unit")) - 1))  # a row a unit
        found = codes.select("unit", "_u", F.pmod(F.xxhash64("unit"), F.lit(2)).alias("odd")).orderBy("_u").toArrow()
        self.units, self.odd = found.column("unit").combine_chunks(), found.column("odd").to_numpy()
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("low"), F.max("_t").alias("high")).first()
        width = max((size.high - size.low) / (size.n // PIECE_ROWS + 1), 1e-9) if size.n else 1.0

        def pack(piece: pa.Table) -> pa.Table:
            return pa.Table.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), piece.column(c).combine_chunks()) for c in ("_t", "_u")], names=["_t", "_u"])

        pieces = rows.join(codes, "unit").withColumn("_piece", F.floor(F.col("_t") / F.lit(width))).groupBy("_piece").applyInArrow(pack, f"_t array<{rows.schema['_t'].dataType.simpleString()}>, _u array<int>")
        self.pieces = checkpointed(pieces).coalesce(1)
        n = len(self.units)
        every = self.run(np.arange(n), np.zeros(n, dtype=np.int64), lambda rows: ((u, k) for u, k, _ in rows), {"u": "int", "k": "double"}).toArrow()
        self.degree = np.zeros(n)  # each unit's w with all others
        self.degree[every.column("u").to_numpy()] = every.column("k").to_numpy()
        self.total = float(self.degree.sum())

    def run(self, units, label, each, schema: dict[str, str]) -> DataFrame:
        """The rows that `each` makes of (unit, its degree, a function that gives its w with all units of each label) of the units given, those of one label one after the other in a task. Units are places in self.units, labels numbers from 0 on."""
        import numpy as np
        import pyarrow as pa

        within, tasks, n_labels = self.within, min(COINCIDENCE_TASKS, max(1, -(-len(units) // 64))), int(label.max()) + 1 if len(label) else 0
        place = np.full(len(label), -1, dtype=np.int32)
        units = np.asarray(units)
        units = units[np.argsort(label[units], kind="stable")]
        place[units] = np.arange(len(units)) * tasks // max(len(units), 1)

        def counted(task, at, u):
            order = np.argsort(at, kind="stable")
            at, u = at[order], u[order]
            of = label[u]
            own = np.flatnonzero(place[u] == task)
            x, c = at[own], u[own]
            ends = [np.searchsorted(at, x + d, side) for d, side in ((-within, "left"), (-within, "right"), (within, "left"), (within, "right"))]
            order = np.lexsort((c, label[c]))
            x, c, ends = x[order], c[order], [e[order] for e in ends]
            starts = np.flatnonzero(np.diff(c, prepend=-1))
            for s, e in zip(starts.tolist(), np.append(starts, len(c))[1:].tolist(), strict=True):
                y, code = x[s:e], int(c[s])
                a, b, c0, d = (z[s:e] for z in ends)  # once counted from a to b and from c0 to d, twice between
                itself = int(sum((np.searchsorted(y, y + within, side) - np.searchsorted(y, y - within, side)).sum() for side in ("left", "right")))
                degree = int((c0 - a).sum() + (d - b).sum()) - itself

                def towards(a=a, b=b, c0=c0, d=d, code=code, itself=itself):
                    w = 2 * np.bincount(np.concatenate([of[i:j] for i, j in zip(b.tolist(), c0.tolist(), strict=True)]), minlength=n_labels)
                    for i, j in [*zip(a, b, strict=True), *zip(c0, d, strict=True)]:
                        if i < j:
                            w += np.bincount(of[i:j], minlength=n_labels)
                    w[label[code]] -= itself
                    return w

                yield code, degree, towards

        def sweep(batches):
            task, at, u = None, [], []
            for batch in batches:
                if batch.num_rows:
                    task = batch.column("id")[0].as_py()
                    at.append(batch.column("_t").flatten().to_numpy())
                    u.append(batch.column("_u").flatten().to_numpy())
            rows = []
            for row in each(counted(task, np.concatenate(at), np.concatenate(u)) if at else ()):
                rows.append(row)
                if len(rows) == 1 << 14:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, {"int": pa.int32(), "double": pa.float64()}[k]) for c, k in zip(zip(*rows, strict=True), schema.values(), strict=True)], names=list(schema))

        shares = self.spark.range(0, tasks, 1, tasks).hint("shuffle_replicate_nl")  # a task for each share reads the stored pieces; none is copied
        return shares.crossJoin(self.pieces).mapInArrow(sweep, ", ".join(f"{k} {v}" for k, v in schema.items()))

    def clusters(self, rounds: int = 20, resolution: float = 1.0):
        """modularity_clusters() of this graph: each unit's cluster, as places in self.units."""
        import numpy as np

        degree, total, label = self.degree, self.total, np.arange(len(self.units))
        for turn in range(rounds if total else 0):
            names, of = np.unique(label, return_inverse=True)
            weight = np.bincount(of, weights=degree)

            def best(rows, of=of, weight=weight):
                for code, k, towards in rows:
                    if not k:
                        continue
                    w, own = towards(), of[code]
                    near = np.flatnonzero(w)
                    others = weight[near] - np.where(near == own, float(k), 0.0)
                    gain = np.round(w[near] - resolution * float(k) * others / total, 9)
                    top = gain.max()
                    ties = near[gain == top]
                    if top > 0 and own not in ties:
                        yield code, int(ties[0])

            moves = self.run(np.flatnonzero(self.odd == turn % 2), of, best, {"u": "int", "to": "int"}).toArrow()
            label[moves.column("u").to_numpy()] = names[moves.column("to").to_numpy()]
            if not len(moves) and turn % 2:
                break
        return label

    def labels(self, label) -> DataFrame:
        """node, cluster of units that coincide with others."""
        import numpy as np
        import pyarrow as pa

        known = np.flatnonzero(self.degree)
        return self.spark.createDataFrame(pa.table({"node": self.units.take(pa.array(known)), "cluster": self.units.take(pa.array(label[known]))}))

    def weights(self, label) -> DataFrame:
        """_a, _b, w: weight between clusters, in parts; clusters are places in np.unique(label)."""
        import numpy as np

        of = np.unique(label, return_inverse=True)[1]

        def sums(rows):
            cluster, total = None, None
            for code, _, towards in rows:
                if cluster is not None and of[code] != cluster:
                    yield from ((cluster, b, float(total[b])) for b in np.flatnonzero(total).tolist())
                    cluster = None
                total = towards() if cluster is None else total + towards()
                cluster = int(of[code])
            if cluster is not None:
                yield from ((cluster, b, float(total[b])) for b in np.flatnonzero(total).tolist())

        return self.run(np.flatnonzero(self.degree), of, sums, {"_a": "int", "_b": "int", "w": "double"})

    def links(self, label) -> DataFrame:
        """cluster_links() of this graph."""
        import numpy as np
        import pyarrow as pa

        names = np.unique(label)
        w = self.weights(label).groupBy("_a", "_b").agg(F.sum("w").alias("w"))
        cluster = self.units.take(pa.array(names))
        named = lambda i, c: F.broadcast(self.spark.createDataFrame(pa.table({i: pa.array(np.arange(len(names), dtype=np.int32)), c: cluster})))
        return link_ratios(checkpointed(w.join(named("_a", "a"), "_a").join(named("_b", "b"), "_b").select("a", "b", "w")))

    def modularity(self, label) -> DataFrame:
        """modularity() of this graph: one row, null without edges. label: any value for each of self.units."""
        k = self.weights(label).groupBy("_a").agg(F.sum("w").alias("_k"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("w")).otherwise(0.0)).alias("_in"))
        q = k.agg(F.sum("_in").alias("_in"), F.sum("_k").alias("_t"), F.sum(F.col("_k") * F.col("_k")).alias("_q"))
        return q.select((F.col("_in") / F.col("_t") - F.col("_q") / (F.col("_t") * F.col("_t"))).alias("modularity"))


def merge_tree(links: DataFrame) -> list[tuple[int, int, float]]:
    """O-SRT-12: (kept, joined, ratio) in order: the two clusters with the highest ratio are joined until one is left. Clusters are a bounded table (hundreds)."""
    w = {(r["a"], r["b"]): r["w"] for r in links.select("a", "b", "w").collect()}
    k: dict = {}
    for (a, _), v in w.items():
        k[a] = k.get(a, 0.0) + v
    total, out = sum(k.values()), []
    while len(k) > 1:
        ratio = {(a, b): v * total / (k[a] * k[b]) for (a, b), v in w.items() if a < b}
        if not ratio:
            break
        a, b = max(ratio, key=lambda p: (ratio[p], [-x for x in p]))
        out.append((a, b, ratio[a, b]))
        for (x, y), v in list(w.items()):
            if b in (x, y):
                del w[x, y]
                x, y = a if x == b else x, a if y == b else y
                w[x, y] = w.get((x, y), 0.0) + v
        k[a] += k.pop(b)
    return out


def spike_positions(features: DataFrame, contacts: DataFrame, spike_id: str, ch: str, weight: str, limit: float) -> DataFrame:
    """O-SRT-16: spike_id, x, y: positions of the spike's channels weighted by squared feature norm, channels within `limit` of the strongest."""
    rows = features.join(contacts.select(F.col("ch").alias(ch), "x", "y"), ch)
    top = rows.groupBy(spike_id).agg(F.max_by(F.struct("x", "y"), F.struct(F.col(weight), -F.col(ch))).alias("_top"))
    near = rows.join(top, spike_id).filter(F.hypot(F.col("x") - F.col("_top.x"), F.col("y") - F.col("_top.y")) <= limit)
    w = F.col(weight) * F.col(weight)
    return near.groupBy(spike_id).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"))


def feature_channels(features: DataFrame, unit: str, ch: str, norm: str, k: int) -> DataFrame:
    """O-SRT-17: unit, ch, rank of the k channels with the greatest mean squared norm over the unit's spikes."""
    e = features.groupBy(unit, ch).agg(F.avg(F.col(norm) * F.col(norm)).alias("energy"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy(unit).orderBy(F.desc("energy"), ch)).cast("long")).filter(F.col("rank") <= k)


def simulated_spikes(spark, units: int, seconds: float, rate: float, seed: int = 0) -> DataFrame:
    """O-SRT-23: unit, t: Poisson trains with a refractory pause of 2 ms, deterministic by seed: intervals are -log(u) / rate from hashes."""
    n = int(seconds * rate * 2) + 20
    u = (F.pmod(F.xxhash64("unit", "i", F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    rows = spark.range(units).withColumnRenamed("id", "unit").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.withColumn("isi", 0.002 - F.log(u) / rate)
    w = Window.partitionBy("unit").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # a unit's spikes are bounded by seconds * rate
    return rows.withColumn("t", F.sum("isi").over(w)).filter(F.col("t") < seconds).select("unit", "t")


def bimodality_score(values: DataFrame, keys: list[str], value: str, bins: int = 50) -> DataFrame:
    """O-SRT-13: keys, score: 1 - lowest count near the middle over the smaller of the two sides' highest counts, from a histogram over -3..3 deviations; 0 where a side is empty."""
    m = values.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")).filter("_s > 0")
    at = F.floor(((F.col(value) - F.col("_m")) / F.col("_s") + 3) / 6 * bins).cast("long")
    counts = values.join(m, keys).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("bin").between(0, bins - 1))
    grid = m.select(*keys).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    h = grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mid, reach = bins // 2, bins // 8
    side = h.groupBy(*keys).agg(F.max(F.when(F.col("bin") < mid - reach, F.col("n"))).alias("_a"), F.max(F.when(F.col("bin") > mid + reach, F.col("n"))).alias("_b"), F.min(F.when(F.abs(F.col("bin") - mid) <= reach, F.col("n"))).alias("_v"))
    low = F.least("_a", "_b")
    return side.select(*keys, F.when(low > 0, F.greatest(1 - F.col("_v") / low, F.lit(0.0))).otherwise(0.0).alias("score"))
