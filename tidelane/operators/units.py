"""Unit analytics: correlograms, event-aligned histograms, rate maps, waveforms, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .meetings import Meetings, half_up, metrics
from .ordered import checkpointed, nearest, previous, range_join, rank_of, running


def close_pairs(a: DataFrame, b: DataFrame, keys: list[str], t: str, within) -> DataFrame:
    """Pairs (a's columns, b's with prefix b_) with -within <= b_t - t < within: an equi-join on buckets as wide as the window."""
    x = a.withColumn("_k", F.explode(F.array(*[F.floor(F.col(t) / within) + d for d in (-1, 0, 1)])))
    y = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys]).withColumn("_k", F.floor(F.col(f"b_{t}") / within))
    gap = F.col(f"b_{t}") - F.col(t)
    return x.join(y, [*keys, "_k"]).filter((gap >= -within) & (gap < within)).drop("_k")


def pearson(x: Column, y: Column) -> Column:
    """An aggregate: Pearson's r of rows that have both, null where either is constant (Spark's corr divides by zero there, and does so even behind a condition)."""
    both = lambda c: F.stddev_pop(F.when(x.isNotNull() & y.isNotNull(), c))
    return F.covar_pop(x, y) / F.nullif(both(x) * both(y), F.lit(0.0))


def _lists(rows):
    """numpy rows of one length as an Arrow array of lists."""
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _coded(column):
    """numpy codes of an Arrow column's values from 0 on, null among them, and the values."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if hasattr(coded, "chunks") else coded
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


#: Labels of one side that a cell of pair_counts() holds, and pairs and rows that it is meant for.
CELL_LABELS, CELL_PAIRS, CELL_ROWS = 384, 1 << 27, 1 << 21


def pair_counts(a: DataFrame, b: DataFrame, t: str, before, after, bin_of, n_bins: int, keys: list[str] | None = None) -> DataFrame:
    """keys, unit, other, n: by pair of a's and b's units, the numbers of rows with -before <= b - a < after in each of n_bins bins; pairs without any have no row.

    bin_of: numpy bins (0 to n_bins - 1, others are left out) of an array of lags b - a. Blocks of units of both sides meet in cells, and a cell's pairs are
    counted in arrays, unit by unit: no pair is ever a row, and a row of a or b is copied once for each block of the other side. Cells of many pairs
    are cut along time, too, and only then are counts added up in an exchange, a row for each pair of units and cut.
    """
    import numpy as np
    import pyarrow as pa

    keys = keys or []
    stat = [F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high")]
    sides, sizes = [a.filter(F.col(t).isNotNull()).select(*keys, "unit", t), b.filter(F.col(t).isNotNull()).select(*keys, "unit", t)], []
    for side in sides:
        sizes.append(side.groupBy(*keys, "unit").agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("low"), F.max(t).alias("high")).agg(*stat).first())
    blocks = [max(1, -(-s.u // CELL_LABELS)) for s in sizes]
    cuts, width = 1, None
    if all(s.u for s in sizes):
        most = [max(s.n / k, s.most) for s, k in zip(sizes, blocks, strict=True)]  # rows of the largest block, about
        low, high = min(s.low for s in sizes), max(s.high for s in sizes)
        pairs = most[0] * most[1] * min(1.0, (before + after) / max(high - low, 1e-9))
        cuts = int(max(pairs // CELL_PAIRS, sum(most) // CELL_ROWS)) + 1
        width = max((high - low) / cuts, before + after) if cuts > 1 else None
    block = lambda i: F.pmod(F.xxhash64("unit"), F.lit(blocks[i])).alias("_own")
    every = lambda i: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[i] - 1).cast("long"))).alias("_met")
    cut = lambda c: F.lit(0).cast("long") if width is None else F.floor(c / F.lit(width)).cast("long")
    left = sides[0].select("*", block(0), cut(F.col(t)).alias("_cut")).select("*", every(1)).select(*keys, F.col("_own").alias("_a"), F.col("_met").alias("_b"), "_cut", F.lit(0).alias("_side"), "unit", F.col(t).alias("_t"))
    right = sides[1].select("*", block(1), F.explode(F.sequence(cut(F.col(t) - after), cut(F.col(t) + before))).alias("_cut")).select("*", every(0)).select(*keys, F.col("_met").alias("_a"), F.col("_own").alias("_b"), "_cut", F.lit(1).alias("_side"), "unit", F.col(t).alias("_t"))
    kind = a.schema["unit"].dataType.simpleString()
    own_keys = [f"`{k}` {a.schema[k].dataType.simpleString()}" for k in keys]

    def count(rows: pa.Table) -> pa.Table:
        side, at = rows.column("_side").to_numpy(), rows.column("_t").to_numpy()
        code, names = _coded(rows.column("unit"))
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        two = two[np.argsort(at[two], kind="stable")]
        one = one[np.lexsort((at[one], code[one]))]
        x, y = at[one], at[two]
        labels_b, place = np.unique(code[two], return_inverse=True)
        first = np.searchsorted(y, x - before, "left")
        n = np.searchsorted(y, x + after, "left") - first
        ends = np.cumsum(n)
        labels_a, starts = np.unique(code[one], return_index=True)
        size = len(labels_b) * n_bins
        units, others, found = [], [], []
        for label, s, e in zip(labels_a, starts, np.append(starts, len(one))[1:], strict=True):
            total = np.zeros(size, dtype=np.int64)
            while s < e:
                done = ends[s - 1] if s else 0
                stop = min(max(int(np.searchsorted(ends, done + (1 << 18), "right")), s + 1), e)
                m = n[s:stop]
                k = int(ends[stop - 1] - done)
                j = np.arange(k) + np.repeat(first[s:stop] - (np.cumsum(m) - m), m)
                bins = bin_of(y[j] - np.repeat(x[s:stop], m))
                slot = place[j] * n_bins + bins
                fits = (bins >= 0) & (bins < n_bins)
                total += np.bincount(slot if fits.all() else slot[fits], minlength=size)
                s = stop
            total = total.reshape(-1, n_bins)
            hit = np.flatnonzero(total.any(axis=1))
            units.append(np.full(len(hit), label))
            others.append(labels_b[hit])
            found.append(total[hit])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        u, o = cat(units, np.int64), cat(others, np.int64)
        lists = _lists(np.concatenate(found) if found else np.zeros((0, n_bins), np.int64))
        fixed = [pa.repeat(rows.column(i)[0], len(u)) for i in range(len(keys))]
        return pa.Table.from_arrays([*fixed, names.take(pa.array(u)), names.take(pa.array(o)), lists], names=[*keys, "unit", "other", "n"])

    wide = left.unionByName(right).groupBy(*keys, "_a", "_b", "_cut").applyInArrow(count, ", ".join([*own_keys, f"unit {kind}, other {kind}, n array<long>"]))
    return wide if width is None else added(wide, [*keys, "unit", "other"], n_bins)


def added(wide: DataFrame, keys: list[str], size: int, column: str = "n") -> DataFrame:
    """keys and the sum of arrays of one size, place by place."""
    return wide.groupBy(*keys).agg(F.array(*[F.sum(F.col(column)[i]) for i in range(size)]).alias(column))


def correlogram_rows(a: DataFrame, b: DataFrame, t: str, bin_width, n_bins: int, keys: list[str] | None = None) -> DataFrame:
    """correlogram() with a row for each pair: keys, unit, other, n (an array of the counts of bins -n_bins to n_bins)."""
    import numpy as np

    if not keys:
        return meeting_rows(Meetings(a, t, bin_width, n_bins, None if a is b else b))
    window = bin_width * n_bins + bin_width / 2
    return pair_counts(a, b, t, window, window, lambda lag: np.rint(lag / bin_width).astype(np.int64) + n_bins, 2 * n_bins + 1, keys)


def meeting_rows(meet: Meetings) -> DataFrame:
    """unit, other, n of correlogram_rows()."""

    def each(train):
        hit, n = train.others()
        return hit, [_lists(n.T)]

    return meet.run(each, "n array<long>")


def long_rows(wide: DataFrame, keys: list[str], first: int, values: dict[str, str]) -> DataFrame:
    """keys, bin (from `first` on) and, by new name, each place of the columns' arrays."""
    cells = F.posexplode(F.arrays_zip(*[F.col(c).alias(v) for v, c in values.items()]))
    return wide.select(*keys, cells.alias("_i", "_c")).select(*keys, (F.col("_i") + first).cast("long").alias("bin"), *[F.col(f"_c.{v}").alias(v) for v in values])


def correlogram(a: DataFrame, b: DataFrame, t: str, bin_width, n_bins: int, keys: list[str] | None = None) -> DataFrame:
    """O-CCG-01/05: keys, unit, other, bin (-n_bins to n_bins), n of rounded lags b - a; empty bins of pairs that meet are 0.

    A pair counts where b lies in [a - window, a + window); the zero lag of a spike with itself is included, as given.
    """
    return long_rows(correlogram_rows(a, b, t, bin_width, n_bins, keys), [*(keys or []), "unit", "other"], -n_bins, {"n": "n"})


def _erf(x: Column) -> Column:
    """The error function to 1.5e-7 by a rational approximation, in built-in arithmetic."""
    a = F.abs(x)
    u = 1 / (1 + 0.3275911 * a)
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def correlogram_metrics(ccg: DataFrame, keys: list[str], far: tuple[int, int], near: tuple[int, int], centres: int, n_bins: int | None = None) -> DataFrame:
    """O-CCG-02: by pair, r and q of a dense correlogram, and shoulder, the greatest mean count of its shoulders.

    Shoulders are the far bins of both sides together (a to b - 1 after the zero lag, a + 1 to b - 1 before) and the near
    bins of each side (a to b - 1 after, a + 1 to b before). r is the least density within 1 to `centres` bins of the
    zero lag, which itself is left out, over the greatest of the shoulders; q the least probability of so few counts there.
    n_bins: ccg is correlogram_rows() with bins -n_bins to n_bins, and each row is measured by itself.
    """
    def over(bins, size) -> Column:
        if n_bins is None:
            return F.sum(F.when(F.col("bin").isin(bins), F.col("n")).otherwise(0)) / size
        return sum((F.col("n")[k + n_bins] for k in bins if abs(k) <= n_bins), F.lit(0)) / size

    (f0, f1), (n0, n1) = far, near
    sides = [over([*range(f0, f1), *range(1 - f1, -f0)], 2 * (f1 - f0) - 1), over([*range(n0, n1)], n1 - n0), over([*range(-n1, -n0)], n1 - n0)]
    inner = [over([k for k in range(-i, i + 1) if k], 1.0).alias(f"_c{i}") for i in range(1, centres + 1)]
    cells = [F.greatest(*sides).alias("shoulder"), *inner]
    out = ccg.groupBy(*keys).agg(*cells) if n_bins is None else ccg.select(*keys, *cells)
    least = lambda cells: cells[0] if len(cells) == 1 else F.least(*cells)
    r = least([F.col(f"_c{i}") / (2 * i) for i in range(1, centres + 1)]) / F.when(F.col("shoulder") > 0, F.col("shoulder"))
    expected = lambda i: F.col("shoulder") * i
    q = least([0.5 * (1 + _erf((F.col(f"_c{i}") / 2 - expected(i)) / F.sqrt(1e-10 + 2 * expected(i)))) for i in range(1, centres + 1)])
    return out.select(*keys, r.alias("r"), q.alias("q"), "shoulder")


def meeting_metrics(meet: Meetings, far: tuple[int, int], near: tuple[int, int], centres: int, r_digits: int | None = None, q_digits: int | None = None) -> DataFrame:
    """O-CCG-02: unit, other, r, q of correlogram_metrics() without its correlograms, rounded if digits are given."""
    import pyarrow as pa

    def each(train):
        hit, n = train.others()
        r, q = metrics(n, meet_bins, far, near, centres)
        return hit, [pa.array(half_up(r, r_digits), from_pandas=True), pa.array(half_up(q, q_digits))]

    meet_bins = meet.n_bins
    return meet.run(each, "r double, q double")


def meeting_refractory(meet: Meetings, far: tuple[int, int], near: tuple[int, int], centres: int, own: tuple[float, float], cross: tuple[float, float], r_digits: int | None = None) -> DataFrame:
    """O-CCG-03/04: unit, other, r, refractory: r and q below the limits of `own` for autocorrelograms, of `cross` for others; unknown counts as not."""
    import numpy as np
    import pyarrow as pa

    n_bins = meet.n_bins

    def each(train):
        hit, n = train.others()
        r, q = metrics(n, n_bins, far, near, centres)
        itself = hit == train.code
        under = (r < np.where(itself, own[0], cross[0])) & (q < np.where(itself, own[1], cross[1]))
        return hit, [pa.array(half_up(r, r_digits), from_pandas=True), pa.array(under)]

    return meet.run(each, "r double, refractory boolean")


def refractory(metrics: DataFrame, r_limit: float, q_limit: float) -> DataFrame:
    """O-CCG-03: metrics with `refractory`: r and q below their limits; unknown counts as not. Autocorrelograms have limits of 0.2 and 0.2, pairs of 0.25 and 0.05."""
    return metrics.withColumn("refractory", F.coalesce((F.col("r") < r_limit) & (F.col("q") < q_limit), F.lit(False)))


def refractory_units(spikes: DataFrame, t: str, bin_width, n_bins: int, far: tuple[int, int], near: tuple[int, int], centres: int, r_limit: float = 0.2, q_limit: float = 0.2, least: int = 10) -> DataFrame:
    """O-CCG-03: unit, r, refractory of each unit's autocorrelogram; units with no more than `least` spikes, or all at one time, are not."""
    sized = spikes.groupBy("unit").agg(F.count(F.lit(1)).alias("_n"), (F.max(t) > F.min(t)).alias("_long"))
    own = spikes.select("unit", F.col(t).alias("_t"), F.col("unit").alias("_own"))
    pairs = close_pairs(own, own, ["_own"], "_t", bin_width * n_bins + bin_width / 2)
    counts = pairs.groupBy("unit", F.rint((F.col("b__t") - F.col("_t")) / bin_width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    metrics = refractory(correlogram_metrics(counts, ["unit"], far, near, centres), r_limit, q_limit)
    known = F.col("_n") > least
    return sized.join(metrics, "unit", "left").select("unit", F.when(known & F.col("_long"), F.col("r")).alias("r"), (known & F.col("_long") & F.coalesce("refractory", F.lit(False))).alias("refractory"))


def pair_matrix(ccg: DataFrame, far: tuple[int, int], near: tuple[int, int], centres: int, own: tuple[float, float] = (0.2, 0.2), cross: tuple[float, float] = (0.25, 0.05), n_bins: int | None = None) -> DataFrame:
    """O-CCG-04: unit, other, r, refractory of every pair that meets: autocorrelograms by the limits of `own`, others by those of `cross`."""
    found = correlogram_metrics(ccg, ["unit", "other"], far, near, centres, n_bins)
    under = lambda limits: F.coalesce((F.col("r") < limits[0]) & (F.col("q") < limits[1]), F.lit(False))
    return found.select("unit", "other", "r", F.when(F.col("unit") == F.col("other"), under(own)).otherwise(under(cross)).alias("refractory"))


def shape_gate(ccg: DataFrame, first: int, last: int, least: float = 0.8) -> DataFrame:
    """O-SRT-24: unit, other (the higher), r_unit, r_other, alike: Pearson's r of a pair's correlogram with both autocorrelograms over lags `first` to `last`, sides averaged and smoothed over three bins; alike if both reach `least`. Flat shapes have no r."""
    k = F.abs("bin")
    sides = ccg.filter(k.between(first, last)).groupBy("unit", "other", k.alias("lag")).agg((F.sum("n") / 2).alias("_n"))
    around = Window.partitionBy("unit", "other").orderBy("lag").rangeBetween(-1, 1)  # a pair's lags: bounded by the number of bins
    shape = sides.withColumn("_n", F.sum("_n").over(around) / 3)
    own = shape.filter("unit = other")
    pair = shape.filter("unit < other").join(own.select("unit", "lag", F.col("_n").alias("_u")), ["unit", "lag"], "left").join(own.select("other", "lag", F.col("_n").alias("_o")), ["other", "lag"], "left")
    safe = lambda c: F.when((F.stddev_pop("_n") > 1e-12) & (F.stddev_pop(c) > 1e-12), pearson(F.col("_n"), F.col(c)))
    found = pair.groupBy("unit", "other").agg(safe("_u").alias("r_unit"), safe("_o").alias("r_other"))
    return found.withColumn("alike", F.coalesce((F.col("r_unit") >= least) & (F.col("r_other") >= least), F.lit(False)))


def _folded(n, n_bins: int, first: int, last: int):
    """Shapes of rows of counts: lags `first` to `last`, sides averaged and smoothed over three bins."""
    import numpy as np

    k = np.arange(first, last + 1)
    side = np.pad((n[:, n_bins + k] + n[:, n_bins - k]) / 2, ((0, 0), (1, 1)))
    return (side[:, :-2] + side[:, 1:-1] + side[:, 2:]) / 3


def _alike(p, q):
    """Pearson's r of the rows of p and q, NaN where either is flat or missing (NaN)."""
    import numpy as np

    x, y = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
    sx, sy = np.sqrt((x * x).mean(axis=1)), np.sqrt((y * y).mean(axis=1))
    known = (sx > 1e-12) & (sy > 1e-12)
    return np.where(known, (x * y).mean(axis=1) / np.where(known, sx * sy, 1.0), np.nan)


def shape_gate_rows(wide: DataFrame, n_bins: int, first: int, last: int, least: float = 0.8) -> DataFrame:
    """O-SRT-24: shape_gate() of correlogram_rows(): a pair meets its units' autocorrelograms in joins of a row each."""
    import numpy as np
    import pyarrow as pa

    size = last - first + 1

    def shapes(batches):
        for batch in batches:
            n = batch.column("n").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * n_bins + 1)
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("other"), _lists(_folded(n, n_bins, first, last))], names=["unit", "other", "s"])

    kind = wide.schema["unit"].dataType.simpleString()
    shape = wide.filter("unit <= other").select("unit", "other", "n").mapInArrow(shapes, f"unit {kind}, other {kind}, s array<double>")
    own = shape.filter("unit = other")
    pair = shape.filter("unit < other").join(own.select("unit", F.col("s").alias("u")), "unit", "left").join(own.select("other", F.col("s").alias("o")), "other", "left")

    def compare(batches):
        for batch in batches:
            columns = [batch.column("unit"), batch.column("other")]
            p = np.array(batch.column("s").flatten()).reshape(-1, size)
            for c in (batch.column("u"), batch.column("o")):
                q = np.full_like(p, np.nan)
                q[~np.array(c.is_null().to_numpy(zero_copy_only=False))] = np.array(c.drop_null().flatten()).reshape(-1, size)
                columns.append(pa.array(_alike(p, q), from_pandas=True))
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "other", "r_unit", "r_other"])

    found = pair.select("unit", "other", "s", "u", "o").mapInArrow(compare, f"unit {kind}, other {kind}, r_unit double, r_other double")
    return found.withColumn("alike", F.coalesce((F.col("r_unit") >= least) & (F.col("r_other") >= least), F.lit(False)))


def meeting_shape_gate(meet: Meetings, first: int, last: int, least: float = 0.8, digits: int | None = None) -> DataFrame:
    """O-SRT-24: shape_gate() without its correlograms: a first pass gives the driver the shape of each unit's autocorrelogram, a second compares all pairs with them. r is rounded before it is compared, if digits are given."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n_bins, kind = meet.n_bins, meet.kind
    itself = meet.run(lambda train: ([train.code], [pa.array([train.code], pa.int32()), _lists(train.itself()[None, :])]), "code int, n array<long>", paired=False).select("code", "n").toArrow()
    own = np.full((len(meet.units), last - first + 1), np.nan)
    n = itself.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * n_bins + 1)
    own[itself.column("code").to_numpy()] = _folded(n, n_bins, first, last)
    rank = np.empty(len(meet.units), dtype=np.int64)
    rank[pc.sort_indices(meet.units).to_numpy()] = np.arange(len(rank))
    rank[meet.units.is_null().to_numpy(zero_copy_only=False)] = -1

    def each(train):
        if rank[train.code] < 0:
            return [], []
        hit, n = train.others()
        after = np.flatnonzero(rank[hit] > rank[train.code])
        hit, p = hit[after], _folded(n.T[after], n_bins, first, last)
        r, o = (half_up(_alike(p, q), digits) for q in (own[train.code][None, :], own[hit]))
        return hit, [pa.array(r, from_pandas=True), pa.array(o, from_pandas=True), pa.array((r >= least) & (o >= least))]

    return meet.run(each, "r_unit double, r_other double, alike boolean")


def acg_metrics(acg: DataFrame, keys: list[str], inner: tuple[int, int], outer: tuple[int, int], trough: tuple[int, int], peak: tuple[int, int]) -> DataFrame:
    """O-CCG-06: burst index (mean of inner over mean of outer bins) and modulation index ((peak - trough) / (peak + trough)), bins by absolute lag."""
    mean = lambda r: F.avg(F.when(F.abs("bin").between(*r), F.col("n")))
    p, q, a, b = mean(peak), mean(trough), mean(inner), mean(outer)
    return acg.groupBy(*keys).agg(F.when(b > 0, a / b).alias("burst"), F.when(p + q > 0, (p - q) / (p + q)).alias("modulation"))


def log_isi(spikes: DataFrame, keys: list[str], t: str, ticks_per_second: float, low: float = -3.0, step: float = 0.04, bins: int = 100, width=None) -> DataFrame:
    """O-CCG-08: keys, bin, density of log10 intervals in seconds per spike; intervals outside the bins are left out."""
    rows = previous(spikes, keys, t, [], {"_p": t}, width).filter(F.col(t) > F.col("_p"))
    at = F.floor((F.log10((F.col(t) - F.col("_p")) / ticks_per_second) - low) / step).cast("long")
    n = spikes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = rows.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("bin").between(0, bins - 1))
    return counts.join(n, keys).select(*keys, "bin", (F.col("n") / F.col("_n")).alias("density"))


def population_modulation(ccg: DataFrame, centre: int, edge: int) -> DataFrame:
    """O-CCG-09: unit, modulation of its mean correlogram with all others: mean of bins up to centre over mean of those beyond edge."""
    mean = ccg.filter("unit != other").groupBy("unit", "bin").agg(F.avg("n").alias("m"))
    a, b = F.avg(F.when(F.abs("bin") <= centre, F.col("m"))), F.avg(F.when(F.abs("bin") > edge, F.col("m")))
    return mean.groupBy("unit").agg(F.when(b > 0, a / b).alias("modulation"))


def meeting_modulation(meet: Meetings, centre: int, edge: int) -> DataFrame:
    """O-CCG-09: population_modulation() from the counts of each unit's spikes with all others together, for units that aren't null: no pair of units is looked at, and how many others there are cancels out."""
    import numpy as np
    import pyarrow as pa

    k = np.abs(np.arange(-meet.n_bins, meet.n_bins + 1))

    def each(train):
        n = train.everyone() - train.itself()
        low = float(n[k > edge].mean())
        return [train.code] if n.any() else [], [pa.array([float(n[k <= centre].mean()) / low if low > 0 else None], pa.float64())]

    return meet.run(each, "modulation double", paired=False)


def hollow_gaussian(sigma: float, reach: int, hollow: float = 0.6) -> list[float]:
    """Kernel weights for lags -reach to reach with the centre lowered by the hollow fraction, summing to 1."""
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    w[reach] *= 1 - hollow
    return [x / sum(w) for x in w]


def excess_bins(ccg: DataFrame, keys: list[str], sigma: float, reach: int, alpha: float) -> DataFrame:
    """O-CCG-10/11: ccg with `baseline` (hollow-Gaussian weighted mean around each bin, renormalised at the ends) and `excess`: counts above baseline + z * sqrt(baseline), z the normal quantile of alpha shared among the bins."""
    from ..functions.special import normal_quantile

    weights = F.array(*[F.lit(w) for w in hollow_gaussian(sigma, reach)])
    window = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-reach, reach)  # a pair's bins: bounded by the number of bins
    around = F.collect_list(F.struct("bin", "n")).over(window)
    total = F.aggregate(around, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda acc, x: F.struct((acc.s + x.n * F.element_at(weights, (x.bin - F.col("bin") + reach + 1).cast("int"))).alias("s"), (acc.w + F.element_at(weights, (x.bin - F.col("bin") + reach + 1).cast("int"))).alias("w")))
    rows = ccg.withColumn("_t", total).withColumn("baseline", F.col("_t.s") / F.col("_t.w")).drop("_t")
    n_bins = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    z = normal_quantile(1 - F.lit(alpha) / n_bins)
    return rows.withColumn("excess", F.col("n") > F.col("baseline") + z * F.sqrt("baseline"))


def _excess_fit(size: int, sigma: float, reach: int, alpha: float):
    """A function of rows of counts that gives baseline, excess and gain of excess_rows(); a pair's baseline is one matrix product."""
    from statistics import NormalDist

    import numpy as np

    kernel, place = np.array(hollow_gaussian(sigma, reach)), np.arange(size)
    gap = place[:, None] - place[None, :]
    weights = np.where(np.abs(gap) <= reach, kernel[np.clip(gap + reach, 0, 2 * reach)], 0.0)
    total, z = weights.sum(axis=0), NormalDist().inv_cdf(1 - alpha / size)

    def fit(n):
        base = (n @ weights) / total
        over = n > base + z * np.sqrt(base)
        return base, over, np.where(over, np.maximum(n - base, 0.0), 0.0).sum(axis=1)

    return fit


def excess_rows(wide: DataFrame, keys: list[str], size: int, sigma: float, reach: int, alpha: float) -> DataFrame:
    """O-CCG-10/11: excess_bins() of correlogram_rows() with `size` bins: keys, n, baseline, excess (arrays) and gain, the sum of positive excess in excess bins."""
    import pyarrow as pa

    fit = _excess_fit(size, sigma, reach, alpha)

    def fits(batches):
        for batch in batches:
            n = batch.column("n").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            base, over, gain = fit(n)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], _lists(n), _lists(base), _lists(over), pa.array(gain)], names=[*keys, "n", "baseline", "excess", "gain"])

    schema = ", ".join(f"`{k}` {wide.schema[k].dataType.simpleString()}" for k in keys)
    return wide.select(*keys, "n").mapInArrow(fits, f"{schema}, n array<long>, baseline array<double>, excess array<boolean>, gain double")


def meeting_excess(meet: Meetings, what: str, sigma: float, reach: int, alpha: float, bins: tuple[int, int] | None = None, digits: int | None = None) -> DataFrame:
    """O-CCG-10/11: excess_rows() without its correlograms, for pairs of two units that aren't null: unit, other and, by `what`, n and baseline (arrays); probability, the gain per spike of the first; or, for "hits", nothing but the pairs with excess in any of `bins` (first, last)."""
    import numpy as np
    import pyarrow as pa

    fit, n_bins, total = _excess_fit(2 * meet.n_bins + 1, sigma, reach, alpha), meet.n_bins, meet.total
    null = meet.units.is_null().to_numpy(zero_copy_only=False)

    def each(train):
        if null[train.code]:
            return [], []
        hit, n = train.others()
        two = np.flatnonzero((hit != train.code) & ~null[hit])
        hit, n = hit[two], n.T[two]
        base, over, gain = fit(n)
        if what == "baseline":
            return hit, [_lists(n), _lists(half_up(base, digits))]
        if what == "probability":
            return hit, [pa.array(half_up(gain / total[train.code], digits))]
        near = over[:, n_bins + bins[0] : n_bins + bins[1] + 1].any(axis=1)
        return hit[near], []

    return meet.run(each, {"baseline": "n array<long>, baseline array<double>", "probability": "probability double", "hits": ""}[what])


def meeting_rates(meet: Meetings, seconds: float, digits: int | None = None) -> DataFrame:
    """O-CCG-05: unit, other, rate: counts of correlogram_rows() per spike of the first unit and second (an array), for units that aren't null."""
    null, total = meet.units.is_null().to_numpy(zero_copy_only=False), meet.total

    def each(train):
        hit, n = train.others()
        return ([], []) if null[train.code] else (hit, [_lists(half_up(n.T / total[train.code] / seconds, digits))])

    return meet.run(each, "rate array<double>")


def transmission(ccg: DataFrame, spikes: DataFrame, keys: list[str]) -> DataFrame:
    """O-CCG-11: by pair, the sum of positive excess over the baseline in excess bins, per spike of the first unit."""
    n = spikes.groupBy("unit").agg(F.count(F.lit(1)).alias("_n"))
    gain = ccg.groupBy(*keys).agg(F.sum(F.when(F.col("excess"), F.greatest(F.col("n") - F.col("baseline"), F.lit(0.0))).otherwise(0.0)).alias("_g"))
    return gain.join(n, "unit").select(*keys, (F.col("_g") / F.col("_n")).alias("probability"))


def degrees(edges: DataFrame) -> DataFrame:
    """O-CCG-12: unit, n_out, n_in of an edge table (pre, post); units without edges have no row."""
    both = edges.select(F.col("pre").alias("unit"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("post", F.lit(0), F.lit(1)))
    return both.groupBy("unit").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


#: Windows that a cell of psth() and participation() spans.
CELL_WINDOWS = 4


def psth(events: DataFrame, spikes: DataFrame, t: str, bin_width, n_bins: int, ticks_per_second: float, by: list[str] | None = None) -> DataFrame:
    """O-PS-01: unit, bin (-n_bins to n_bins - 1), n, rate: counts of spikes by lag from events, per event and second; dense.

    by: columns of events that split them (event type), each with a row set of its own. Time is cut into cells, and events are copied to the cells that their
    windows meet; there each spike looks up how many events lie in each bin before or after it, so no pair of spike and event is ever made.
    """
    import numpy as np
    import pyarrow as pa

    by = by or []
    window = bin_width * n_bins
    cut = lambda c: F.floor(c / F.lit(CELL_WINDOWS * window)).cast("long")
    total = events.groupBy(*by).agg(F.count(F.lit(1)).alias("_e"))
    kinds = F.broadcast(total.drop("_e"))  # one row for each kind of event
    at = spikes.filter(F.col(t).isNotNull()).select("unit", F.col(t).alias("_t"), cut(F.col(t)).alias("_cut"))
    at = (at.crossJoin(kinds) if by else at).select(*by, "_cut", "unit", "_t")
    from_events = events.filter(F.col(t).isNotNull()).select(*by, F.explode(F.sequence(cut(F.col(t) - window), cut(F.col(t) + window))).alias("_cut"), F.lit(None).cast(spikes.schema["unit"].dataType).alias("unit"), F.col(t).alias("_t"))
    cells = at.withColumn("_event", F.lit(False)).unionByName(from_events.withColumn("_event", F.lit(True)))

    def count(rows: pa.Table) -> pa.Table:
        event, times = rows.column("_event").to_numpy(), rows.column("_t").to_numpy()
        x, y = np.sort(times[event]), times[~event]
        code, names = _coded(rows.column("unit").filter(pa.array(~event)))
        before = [np.searchsorted(x, y - k * bin_width, "right") for k in range(-n_bins, n_bins + 1)]
        n = np.stack([np.bincount(code, weights=before[k] - before[k + 1], minlength=len(names)) for k in range(2 * n_bins)], axis=1).astype(np.int64)
        hit = np.flatnonzero(n.any(axis=1))
        return pa.Table.from_arrays([*[pa.repeat(rows.column(k)[0], len(hit)) for k in range(len(by))], names.take(pa.array(hit)), _lists(n[hit])], names=[*by, "unit", "n"])

    schema = [f"`{k}` {events.schema[k].dataType.simpleString()}" for k in by] + [f"unit {spikes.schema['unit'].dataType.simpleString()}", "n array<long>"]
    counts = added(cells.groupBy(*by, "_cut").applyInArrow(count, ", ".join(schema)), [*by, "unit"], 2 * n_bins)
    units = spikes.select("unit").distinct().crossJoin(F.broadcast(total))  # one row for each kind of event
    out = units.join(counts, [*by, "unit"], "left").withColumn("n", F.coalesce("n", F.array_repeat(F.lit(0).cast("long"), 2 * n_bins)))
    out = long_rows(out, [*by, "unit", "_e"], -n_bins, {"n": "n"})
    return out.withColumn("rate", F.col("n") / F.col("_e") / (bin_width / ticks_per_second)).select(*by, "unit", "bin", "n", "rate")


def psth_modulation(bins: DataFrame, keys: list[str]) -> DataFrame:
    """O-PS-01: ratio (mean rate after / before), index ((after - before) / (after + before)), peak_bin (first of the highest)."""
    after, before = F.avg(F.when(F.col("bin") >= 0, F.col("rate"))), F.avg(F.when(F.col("bin") < 0, F.col("rate")))
    return bins.groupBy(*keys).agg(
        F.when(before > 0, after / before).alias("ratio"), F.when(after + before > 0, (after - before) / (after + before)).alias("index"), F.max_by("bin", F.struct("rate", -F.col("bin"))).alias("peak_bin")
    )


def folded_histogram(spikes: DataFrame, keys: list[str], t: str, period, bin_width, trials: Column, ticks_per_second: float) -> DataFrame:
    """O-PS-02: keys, bin, rate of times folded by period."""
    at = F.floor(F.pmod(F.col(t), F.lit(period)) / bin_width).cast("long")
    return spikes.groupBy(*keys, at.alias("bin")).agg((F.count(F.lit(1)) / trials / (bin_width / ticks_per_second)).alias("rate"))


def participation(spikes: DataFrame, spans: DataFrame, t: str, width, ticks_per_second: float) -> DataFrame:
    """O-PS-05: unit, participation (share of events with a spike), spikes_per_event, rate_inside, over all units and all events (event, start, stop), each row of spans one event.

    width: near the typical event. Within cells of time a spike looks up how many events hold it, and how many of those don't hold its unit's spike before, too.
    """
    import numpy as np
    import pyarrow as pa

    cut = lambda c: F.floor(c / F.lit(CELL_WINDOWS * width)).cast("long")
    at = previous(spikes.filter(F.col(t).isNotNull()).select("unit", t), ["unit"], t, [], {"_p": t}, CELL_WINDOWS * width).select(cut(F.col(t)).alias("_cut"), "unit", F.col(t).alias("_t"), F.col("_p").alias("_o"))
    held = spans.filter("start <= stop").select(F.explode(F.sequence(cut(F.col("start")), cut(F.col("stop")))).alias("_cut"), F.lit(None).cast(spikes.schema["unit"].dataType).alias("unit"), F.col("start").alias("_t"), F.col("stop").alias("_o"))
    cells = at.withColumn("_event", F.lit(False)).unionByName(held.withColumn("_event", F.lit(True)))

    def count(rows: pa.Table) -> pa.Table:
        event, times = rows.column("_event").to_numpy(), rows.column("_t").to_numpy()
        x, stops, y = times[event], rows.column("_o").filter(pa.array(event)).to_numpy(), times[~event]
        order = np.lexsort((stops, x))
        x, stops, ends = x[order], stops[order], np.sort(stops)
        last = rows.column("_o").filter(pa.array(~event))
        first = last.is_null().to_numpy()
        code, names = _coded(rows.column("unit").filter(pa.array(~event)))
        upto, gone = np.searchsorted(x, y, "right"), np.searchsorted(ends, y, "left")
        n = upto - gone
        known = np.where(first, 0, np.searchsorted(x, last.fill_null(0).to_numpy(), "right"))  # events that began by the spike before
        if (stops[1:] >= stops[:-1]).all():
            k = np.maximum(upto - np.maximum(known, gone), 0)
        else:  # events within events: look at those that began since
            k, size = np.zeros(len(y), dtype=np.int64), np.maximum(upto - known, 0)
            done, s = np.cumsum(size), 0
            while s < len(y):
                begun = done[s - 1] if s else 0
                e = min(max(int(np.searchsorted(done, begun + (1 << 20), "right")), s + 1), len(y))
                m = size[s:e]
                own = np.repeat(np.arange(s, e), m)
                j = np.arange(len(own)) + np.repeat(known[s:e] - (np.cumsum(m) - m), m)
                k[s:e] = np.bincount(own[stops[j] >= y[own]] - s, minlength=e - s)
                s = e
        total = lambda v: pa.array(np.bincount(code, weights=v, minlength=len(names)).astype(np.int64))
        return pa.Table.from_arrays([names, total(k), total(n)], names=["unit", "k", "n"])

    found = cells.groupBy("_cut").applyInArrow(count, f"unit {spikes.schema['unit'].dataType.simpleString()}, k long, n long")
    own = found.groupBy("unit").agg(F.sum("k").alias("_k"), F.sum("n").alias("_n"))
    total = spans.agg(F.count(F.lit(1)).alias("_e"), (F.sum(F.col("stop") - F.col("start")) / ticks_per_second).alias("_s"))
    out = spikes.select("unit").distinct().join(own, "unit", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("unit", (F.coalesce("_k", F.lit(0)) / F.col("_e")).alias("participation"), (F.coalesce("_n", F.lit(0)) / F.col("_e")).alias("spikes_per_event"), (F.coalesce("_n", F.lit(0)) / F.col("_s")).alias("rate_inside"))


def rate_map(spikes: DataFrame, track: DataFrame, keys: list[str], t: str, x: str, bin_width: float, sample_rate: float, width=None, moving: Column | None = None) -> DataFrame:
    """O-MAP-01: keys, unit, bin, n, occupancy (samples), rate: spikes by position bin over the time spent there. Spikes take the nearest position; bins without time have no row."""
    where = track if moving is None else track.filter(moving)
    occupancy = where.groupBy(*keys, F.floor(F.col(x) / bin_width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("occupancy"))
    placed = nearest(spikes.select(*keys, "unit", t), where.select(*keys, t, x), keys, t, x, width).filter(F.col(x).isNotNull())
    counts = placed.groupBy(*keys, "unit", F.floor(F.col(x) / bin_width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    units = counts.select(*keys, "unit").distinct()
    grid = units.join(occupancy, keys) if keys else units.crossJoin(F.broadcast(occupancy))  # one row a position bin
    return grid.join(counts, [*keys, "unit", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rate", F.col("n") / F.col("occupancy") * sample_rate)


def place_fields(maps: DataFrame, keys: list[str], share: float = 0.1, least_bins: int = 4, least_peak: float = 8.0) -> DataFrame:
    """O-MAP-02: start, stop, peak of runs of bins above share * the map's peak that are long and high enough."""
    from .intervals import runs

    top = maps.groupBy(*keys).agg(F.max("rate").alias("_top"))
    flagged = maps.join(top, keys).withColumn("_on", F.col("rate") > share * F.col("_top"))
    found = runs(flagged, keys, "bin", "_on").filter("_on").filter(F.col("n") >= least_bins)
    inside = range_join(maps, found.select(*keys, "start", "stop"), keys, "bin", "start", "stop", 16)
    return inside.groupBy(*keys, "start", "stop").agg(F.max("rate").alias("peak")).filter(F.col("peak") > least_peak)


def spatial_coherence(maps: DataFrame, keys: list[str]) -> DataFrame:
    """O-MAP-02: correlation of each bin's rate with the mean of its neighbours'; null where either is constant."""
    rows = previous(previous(maps, keys, "bin", [], {"_a": "rate"}), keys, "bin", [], {"_b": "rate"}, backward=True)
    near = F.col("_a").isNotNull().cast("int") + F.col("_b").isNotNull().cast("int")
    around = (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / F.nullif(near, F.lit(0))  # a map of one bin has no neighbours
    return rows.withColumn("_m", around).groupBy(*keys).agg(pearson(F.col("rate"), F.col("_m")).alias("coherence"))


def coverage(maps: DataFrame, keys: list[str], share: float = 0.75) -> DataFrame:
    """O-MAP-03: peak rate, and the first rank (over n) at which the rates, from the highest on, reach a share of their sum."""
    w = Window.partitionBy(*keys).orderBy(F.desc("rate"), "bin")  # a map's bins: bounded
    rows = maps.withColumn("_c", F.sum("rate").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(w))
    total = maps.groupBy(*keys).agg(F.sum("rate").alias("_t"), F.count(F.lit(1)).alias("_n"), F.max("rate").alias("peak"))
    out = rows.join(total, keys).groupBy(*keys).agg(F.first("peak").alias("peak"), (F.min(F.when(F.col("_c") >= share * F.col("_t"), F.col("_r"))) / F.first("_n")).alias("coverage"))
    return out


def splitter_degree(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """O-MAP-04: sum of |a - b| over sum of (a + b), by key; null where both are 0."""
    pair = a.select(*keys, "bin", F.col(value).alias("_a")).join(b.select(*keys, "bin", F.col(value).alias("_b")), [*keys, "bin"])
    total = F.sum(F.col("_a") + F.col("_b"))
    return pair.groupBy(*keys).agg(F.when(total != 0, F.sum(F.abs(F.col("_a") - F.col("_b"))) / total).alias("degree"))


def linearize_maze(x: Column, y: Column, arm: float, radius: float) -> Column:
    """O-MAP-05: position along a maze of a straight centre arm (from y = -arm to 0 at |x| small) and two half circles back."""
    on_arm = (F.abs(x) <= radius / 4) & (F.abs(y) <= arm)
    angle = F.atan2(y, F.abs(x))
    return F.when(on_arm, y + arm).otherwise(arm + radius * (F.lit(math.pi / 2) - angle) * F.when(x < 0, -1.0).otherwise(1.0))


def phase_histogram(spikes: DataFrame, keys: list[str], phase: str, bins: int, smooth: int = 5, least: int = 500) -> DataFrame:
    """O-MAP-06: keys, bin, n, smoothed: circular histogram of phases (radians), for keys with more than `least` spikes; the smoothing runs around the circle."""
    at = F.floor(F.pmod(F.col(phase), F.lit(2 * math.pi)) / (2 * math.pi / bins)).cast("long")
    counts = spikes.groupBy(*keys, F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = spikes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).drop("_n")
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    dense = grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    half = smooth // 2
    spread = dense.withColumn("bin", F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda d: F.pmod(F.col("bin") + d, F.lit(bins)).cast("long"))))
    return dense.join(spread.groupBy(*keys, "bin").agg((F.sum("n") / smooth).alias("smoothed")), [*keys, "bin"])


def convolve_counts(bins: DataFrame, keys: list[str], value: str, weights: list[float], out: str = "smooth") -> DataFrame:
    """O-MAP-07, O-SIG-21: weighted sum over neighbouring dense bins, as a join of shifted rows: no key is sorted whole. weights are for shifts -k to k."""
    k = len(weights) // 2
    table = F.array(*[F.lit(w) for w in weights])
    moved = bins.select(*keys, F.col("bin").alias("_b"), value).withColumn("_d", F.explode(F.sequence(F.lit(-k), F.lit(k))))
    added = moved.groupBy(*keys, (F.col("_b") + F.col("_d")).alias("bin")).agg(F.sum(F.col(value) * F.element_at(table, F.col("_d") + k + 1)).alias(out))
    return bins.join(added, [*keys, "bin"])


def noise_rules(units: DataFrame, rules: dict[str, tuple[str, float]], both: tuple[str, str] | None, label: str = "label") -> DataFrame:
    """O-CL-01: label becomes noise where any rule holds. rules: column -> (operator among > < >= <= abs< abs>, limit); an unknown value breaks no rule. The rules of `both` count only together."""
    def holds(column: str) -> Column:
        how, limit = rules[column]
        v = F.abs(column) if how.startswith("abs") else F.col(column)
        how = how.removeprefix("abs")
        test = {">": v > limit, "<": v < limit, ">=": v >= limit, "<=": v <= limit}[how]
        return F.coalesce(test, F.lit(False))

    alone = [holds(c) for c in rules if both is None or c not in both]
    if both is not None:
        alone.append(holds(both[0]) & holds(both[1]))
    bad = F.lit(False)
    for c in alone:
        bad = bad | c
    return units.withColumn(label, F.when(bad, "noise").otherwise(F.col(label)))


def cell_type(units: DataFrame, trough_to_peak: str, tau_rise: str) -> DataFrame:
    """O-CL-03: narrow interneuron, wide interneuron or pyramidal cell."""
    narrow = F.coalesce(F.col(trough_to_peak) <= 0.425, F.lit(False))
    wide = F.coalesce((F.col(tau_rise) > 6) & (F.col(trough_to_peak) > 0.425), F.lit(False))
    return units.withColumn("cell_type", F.when(wide, "Wide Interneuron").when(narrow, "Narrow Interneuron").otherwise("Pyramidal Cell"))


def lowest_clean_cutoff(spikes: DataFrame, keys: list[str], t: str, amplitude: str, cutoffs: list[float], refractory, limit: float) -> DataFrame:
    """O-CL-04: keys, cutoff: the lowest amplitude limit at which, and at all higher ones, intervals below refractory stay within a share of the spikes; null if none."""
    grid = spikes.withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs]))).filter(F.col(amplitude) >= F.col("cutoff"))
    rows = previous(grid, [*keys, "cutoff"], t, [], {"_p": t})
    share = rows.groupBy(*keys, "cutoff").agg((F.count_if(F.col(t) - F.col("_p") < refractory) / F.count(F.lit(1))).alias("_s"))
    dirty = share.groupBy(*keys).agg(F.max(F.when(F.col("_s") > limit, F.col("cutoff"))).alias("_d"))
    clean = share.join(dirty, keys).filter(F.col("_d").isNull() | (F.col("cutoff") > F.col("_d"))).groupBy(*keys).agg(F.min("cutoff").alias("cutoff"))
    return spikes.select(*keys).distinct().join(clean, keys, "left")


def redundant_units(spikes: DataFrame, t: str, within, share: float = 0.5) -> DataFrame:
    """O-CL-07: units to drop: of two whose spikes coincide for at least a share of the smaller one's, the smaller (ties: the greater number)."""
    n = spikes.groupBy("unit").agg(F.count(F.lit(1)).alias("_n"))
    met = close_pairs(spikes.select("unit", t), spikes.select("unit", t), [], t, within).filter("unit != b_unit")
    common = met.groupBy("unit", F.col("b_unit").alias("other")).agg(F.count_distinct(t).alias("_c"))
    sized = common.join(n, "unit").join(n.select(F.col("unit").alias("other"), F.col("_n").alias("_m")), "other")
    smaller = (F.col("_n") < F.col("_m")) | ((F.col("_n") == F.col("_m")) & (F.col("unit") > F.col("other")))
    return sized.filter(smaller & (F.col("_c") / F.col("_n") >= share)).select("unit").distinct()


#: Tasks of template_similarity(), and pairs of one of its matrix products.
SIMILAR_TASKS, SIMILAR_PAIRS = 96, 1 << 18


def template_similarity(templates: DataFrame, unit: str, vector: str, above: float | None = None, digits: int | None = None) -> DataFrame:
    """O-CL-06, O-SRT-18: unit, other, similarity (cosine) of all pairs of templates (vectors of one length), unit the lower; those above a limit if it is given, then rounded to digits.

    Templates are stored once, and each task reads all of them for its share of the pairs: matrix products of a few templates with all that follow. Nothing is exchanged.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kind, spark = templates.schema[unit].dataType.simpleString(), templates.sparkSession
    rows = templates.select(F.col(unit).alias("unit"), F.col(vector).cast("array<double>").alias("w")).filter("unit IS NOT NULL AND w IS NOT NULL")

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                yield pa.RecordBatch.from_arrays([one(batch.column("unit")), one(batch.column("w").flatten())], names=["unit", "w"])

    pieces = checkpointed(rows.mapInArrow(pack, f"unit array<{kind}>, w array<double>"))
    n = pieces.agg(F.sum(F.size("unit"))).first()[0] or 0
    tasks = min(SIMILAR_TASKS, max(1, n // 64))

    def products(batches):
        task, names, waves = None, [], []
        for batch in batches:
            if batch.num_rows:
                task = batch.column("id")[0].as_py()
                names.append(batch.column("unit").flatten())
                waves.append(batch.column("w").flatten().to_numpy(zero_copy_only=False))
        if not names:
            return
        names = pa.concat_arrays(names)
        order = pc.sort_indices(names)
        names, x = names.take(order), np.concatenate(waves).reshape(len(names), -1)[order.to_numpy()]
        size = np.linalg.norm(x, axis=1)
        run = pc.run_end_encode(names).run_ends.to_numpy()  # where units end, should one have several templates
        after = np.repeat(run, np.diff(run, prepend=0))
        step = max(1, SIMILAR_PAIRS // len(x))
        for i in range(task * step, len(x), tasks * step):
            j = min(i + step, len(x))
            with np.errstate(invalid="ignore", divide="ignore"):
                found = (x[i:j] @ x[after[i] :].T) / (size[i:j, None] * size[None, after[i] :])
            keep = np.arange(after[i], len(x))[None, :] >= after[i:j, None]
            if above is not None:
                keep &= found > above
            a, b = np.nonzero(keep)
            if len(a):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a + i)), names.take(pa.array(b + after[i])), pa.array(half_up(found[a, b], digits), from_pandas=True)], names=["unit", "other", "similarity"])

    shares = spark.range(0, tasks, 1, tasks).hint("shuffle_replicate_nl")  # a task for each share reads the stored templates; none is copied
    return shares.crossJoin(pieces.coalesce(1)).mapInArrow(products, f"unit {kind}, other {kind}, similarity double")


def merge_groups(edges: DataFrame, unit: str = "unit", other: str = "other") -> DataFrame:
    """O-CL-06, O-SUP-01: node, group (least reachable number) of an undirected edge table, by label propagation with pointer jumping and checkpoints."""
    both = edges.select(F.col(unit).cast("long").alias("u"), F.col(other).cast("long").alias("v")).union(edges.select(F.col(other).cast("long"), F.col(unit).cast("long"))).distinct()
    both = checkpointed(both)
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("g"))
    while True:
        heard = both.join(labels.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("h"))
        step = labels.join(heard, "u").select("u", F.least("g", "h").alias("n"), F.col("g").alias("o"))
        jump = step.join(labels.select(F.col("u").alias("n"), F.col("g").alias("j")), "n", "left").select("u", F.least("n", F.coalesce("j", "n")).alias("g"), F.col("o"))
        jump = checkpointed(jump)
        changed = jump.filter("g != o").limit(1).count()
        labels = jump.select("u", "g")
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("g").alias("group"))


def amplitude_weighted_depth(rows: DataFrame, keys: list[str], weight: str, depth: str) -> DataFrame:
    """O-SRT-05/16: depth weighted by the positive part of the weight; null without any."""
    w = F.greatest(F.col(weight), F.lit(0))
    return rows.groupBy(*keys).agg((F.sum(w * F.col(depth)) / F.when(F.sum(w) > 0, F.sum(w))).alias("depth"))


def running_rate(spikes: DataFrame, keys: list[str], t: str, width=None) -> DataFrame:
    """Spikes with their number in the unit and the running amplitude sum."""
    return running(rank_of(spikes, keys, t, ["id"], "n", width), keys, t, ["id"], {"total": F.col("v")}, "sum", width)
