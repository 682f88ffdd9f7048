"""Sequence operators along a key's axis: edges, intervals between events, gaps, smoothing, greedy thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import checkpointed, previous, rank_of, running


def edges(samples: DataFrame, keys: list[str], t: str, bit: str, width=None) -> DataFrame:
    """O-WIN-01: t, edge (+1 or -1) at the sample before each change of a 0/1 signal."""
    rows = previous(samples, keys, t, [], {"_next": bit}, width, backward=True)
    return rows.withColumn("edge", (F.col("_next") - F.col(bit)).cast("int")).filter("edge IN (1, -1)").select(*keys, t, "edge")


def intervals_between(spikes: DataFrame, keys: list[str], t: str, width=None, ties: tuple[str, ...] = ()) -> DataFrame:
    """spikes with isi (to the one before) and next_isi (to the one after)."""
    rows = previous(spikes, keys, t, list(ties), {"_p": t}, width)
    rows = previous(rows, keys, t, list(ties), {"_n": t}, width, backward=True)
    return rows.withColumn("isi", F.col(t) - F.col("_p")).withColumn("next_isi", F.col("_n") - F.col(t)).drop("_p", "_n")


def spike_train_metrics(spikes: DataFrame, keys: list[str], t: str, burst, refractory, width=None, ties: tuple[str, ...] = ()) -> DataFrame:
    """O-WIN-02/03/04: n, isi_rate (1 / median isi), cv2 (mean of 2|a - b| / (a + b) where below 1.95), burst_index (inner spikes with an isi below `burst` on either side, over n - 1), refractory_per_mille."""
    rows = intervals_between(spikes, keys, t, width, ties)
    a, b = F.col("isi"), F.col("next_isi")
    cv2 = 2 * F.abs(a - b) / (a + b)
    inner = a.isNotNull() & b.isNotNull()
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        n.alias("n"),
        (1 / F.median("isi")).alias("isi_rate"),
        F.avg(F.when(cv2 < 1.95, cv2)).alias("cv2"),
        F.when(n > 1, F.count_if(inner & ((a < burst) | (b < burst))) / (n - 1)).alias("burst_index"),
        (1000 * F.count_if(a < refractory) / n).alias("refractory_per_mille"),
    )


def speed(track: DataFrame, keys: list[str], t: str, x: str, y: str, ticks_per_second: float = 1.0, width=None) -> DataFrame:
    """O-WIN-06: track with speed (0 for the first sample, null where a position is missing) and acceleration (step of speed, 0 first)."""
    rows = previous(track, keys, t, [], {"_t": t, "_x": x, "_y": y}, width)
    moved = F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y")) / ((F.col(t) - F.col("_t")) / ticks_per_second)
    rows = rows.withColumn("speed", F.when(F.col("_t").isNull(), F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 0.0)).otherwise(moved)).drop("_t", "_x", "_y")
    rows = previous(rows.withColumn("_one", F.lit(1)), keys, t, [], {"_s": "speed", "_any": "_one"}, width)
    return rows.withColumn("acceleration", F.when(F.col("_any").isNull(), 0.0).otherwise(F.col("speed") - F.col("_s"))).drop("_s", "_any", "_one")


def fill_gaps(samples: DataFrame, keys: list[str], t: str, value: str, max_gap, width=None) -> DataFrame:
    """O-WIN-07/08: null runs between two values at most max_gap apart are filled linearly; other nulls stay."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    rows = running(samples, keys, t, [], {"_lo": known}, "last", width)
    rows = running(rows, keys, t, [], {"_hi": known}, "last", width, backward=True)
    line = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * ((F.col(t) - F.col("_lo.t")) / (F.col("_hi.t") - F.col("_lo.t")))
    return rows.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_hi.t") - F.col("_lo.t") <= max_gap, line)).drop("_lo", "_hi")


def _around(samples: DataFrame, keys: list[str], t: str, value: str, back: int, ahead: int, width, chunk: int = 4096) -> DataFrame:
    """samples with _sum and _n of the known values from `back` rows before to `ahead` rows after each: rows are numbered in two levels and added up in chunks of numbers with a halo, so no key is sorted whole and a row is copied for a neighbouring chunk at most."""
    from .signals import with_halo

    halo = max(back, ahead)
    rows = with_halo(rank_of(samples, keys, t, [], "_i", width), "_i", max(chunk, halo), halo)
    window = Window.partitionBy(*keys, "chunk").orderBy("_i").rangeBetween(-back, ahead)
    return rows.withColumns({"_sum": F.sum(value).over(window), "_n": F.count(value).over(window)}).filter("core").drop("_i", "chunk", "core")


def moving_average(samples: DataFrame, keys: list[str], t: str, value: str, n: int, out: str = "smooth", width=None) -> DataFrame:
    """O-WIN-09: zero-padded mean over n rows, always divided by n. An even window reaches one row further back than ahead."""
    return _around(samples, keys, t, value, n // 2, (n - 1) // 2, width).withColumn(out, F.col("_sum") / n).drop("_sum", "_n")


def centred_mean(samples: DataFrame, keys: list[str], t: str, value: str, n: int, out: str = "smooth", width=None) -> DataFrame:
    """O-WIN-10: mean of the known values among n rows around each; the window shrinks at the ends. n is made odd by taking one off."""
    half = (n - 1) // 2
    return _around(samples, keys, t, value, half, half, width).withColumn(out, F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))).drop("_sum", "_n")


def fill_states(samples: DataFrame, keys: list[str], t: str, state: str, width=None) -> DataFrame:
    """O-WIN-11: runs of state 0 take the nearer neighbouring state along t's rows, the earlier one on a tie, the only one at the ends."""
    rows = rank_of(samples, keys, t, [], "_i", width)
    known = F.when(F.col(state) != 0, F.struct(F.col("_i").alias("i"), F.col(state).alias("s")))
    rows = running(rows, keys, t, [], {"_lo": known}, "last", width)
    rows = running(rows, keys, t, [], {"_hi": known}, "last", width, backward=True)
    left = F.col("_hi").isNull() | (F.col("_i") - F.col("_lo.i") <= F.col("_hi.i") - F.col("_i"))
    near = F.when(F.col("_lo").isNotNull() & left, F.col("_lo.s")).otherwise(F.col("_hi.s"))
    return rows.withColumn(state, F.when(F.col(state) != 0, F.col(state)).otherwise(F.coalesce(near, F.lit(0)))).drop("_i", "_lo", "_hi")


def _greedy_batches(dead, last, times):
    """Accepted times: each at least `dead` after the last accepted one."""
    kept = []
    for x in times:
        if last is None or x >= last + dead:
            kept.append(x)
            last = x
    return kept


def greedy_thin(events: DataFrame, keys: list[str], t: str, dead, width=None) -> DataFrame:
    """O-WIN-15/16: distinct keys, t kept greedily: t >= last kept + dead.

    What is kept depends on the last kept event, so a lag is not enough. But after a pause of `dead` or more the next
    event is kept whatever came before: such pauses cut a key into independent bursts, the groups of this computation.
    """
    import pandas as pd

    rows = previous(events.select(*keys, t).distinct(), keys, t, [], {"_p": t}, width)
    rows = running(rows.withColumn("_new", F.when(F.col(t) - F.col("_p") < dead, 0).otherwise(1)), keys, t, [], {"_burst": F.col("_new")}, "sum", width).select(*keys, "_burst", t)
    schema = rows.drop("_burst").schema

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = _greedy_batches(dead, None, sorted(pdf[t].tolist()))
        out = pdf.iloc[: len(kept)][[*keys, t]].copy()
        out[t] = kept
        return out

    # bursts of one event need no Python
    sizes = rows.groupBy(*keys, "_burst").agg(F.count(F.lit(1)).alias("_n"))
    sized = rows.join(sizes, [*keys, "_burst"])
    alone = sized.filter("_n = 1").select(*keys, t)
    return alone.union(sized.filter("_n > 1").select(*keys, "_burst", t).groupBy(*keys, "_burst").applyInPandas(thin, schema))


def expand_runs_with_dead_time(spans: DataFrame, keys: list[str], dead: int, last: int | None = None, width=None) -> DataFrame:
    """O-WIN-14: accepted sample indices within runs (start, stop): from each run's start on, every one at least dead + 1 after the last accepted one, across runs. Runs must not overlap.

    A run that begins later than `dead` after the one before is independent of it: such pauses cut a key, and only runs that lie closer together go to Python, each such group by itself.
    """
    import numpy as np
    import pandas as pd

    start, stop = F.col("start").cast("long"), F.col("stop").cast("long")
    rows = spans.select(*keys, start.alias("start"), stop.alias("stop"))
    if last is not None:
        rows = rows.withColumn("start", F.greatest("start", F.lit(last + dead + 1))).filter("start <= stop")
    rows = previous(rows, keys, "start", [], {"_p": "stop"}, width)
    rows = running(rows.withColumn("_new", F.when(F.col("start") - F.col("_p") <= dead, 0).otherwise(1)), keys, "start", [], {"_group": F.col("_new")}, "sum", width).select(*keys, "_group", "start", "stop")
    sized = rows.join(rows.groupBy(*keys, "_group").agg(F.count(F.lit(1)).alias("_n")), [*keys, "_group"])
    alone = sized.filter("_n = 1").select(*keys, F.explode(F.sequence("start", "stop", F.lit(dead + 1).cast("long"))).alias("t"))
    schema = spans.select(*keys).schema.add("t", "long")

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], None
        for a, b in sorted(zip(pdf["start"].tolist(), pdf["stop"].tolist(), strict=True)):
            at = a if held is None else max(a, held + dead + 1)
            while at <= b:
                out.append(at)
                held, at = at, at + dead + 1
        # as arrays: some pandas string columns without rows don't convert to Arrow
        head = {k: np.array([pdf[k].iloc[0]] * len(out), dtype=object) for k in keys}
        return pd.DataFrame(head | {"t": np.array(out, dtype=np.int64)})

    return alone.union(sized.filter("_n > 1").select(*keys, "_group", "start", "stop").groupBy(*keys, "_group").applyInPandas(expand, schema))


def close_pairs_removed(spikes: DataFrame, templates: DataFrame, unit: str, t: str, within, reach: float) -> DataFrame:
    """O-WIN-17: spikes without those of a smaller template that lie within `within` of a spike of a larger one at most `reach` away.

    templates: unit, x, y, size; equal sizes go by the lower unit. Spikes meet in buckets of time, no unit is sorted whole.
    """
    placed = spikes.join(templates.select(unit, "x", "y", "size"), unit)
    big = placed.select(F.col(unit).alias("_u"), F.col(t).alias("_t"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("size").alias("_size"))
    big = big.withColumn("_b", F.explode(F.array(F.floor(F.col("_t") / within) - 1, F.floor(F.col("_t") / within), F.floor(F.col("_t") / within) + 1)))
    small = placed.withColumn("_b", F.floor(F.col(t) / within))
    larger = (F.col("_size") > F.col("size")) | ((F.col("_size") == F.col("size")) & (F.col("_u") < F.col(unit)))
    gone = small.join(big, "_b").filter(larger & (F.abs(F.col(t) - F.col("_t")) <= within) & (F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) <= reach))
    return spikes.join(gone.select(unit, t).distinct(), [unit, t], "left_anti")


def local_maxima(samples: DataFrame, keys: list[str], t: str, value: str, width=None) -> DataFrame:
    """O-WIN-19: t, value of interior maxima; a plateau counts once, at its middle row (the earlier of two)."""
    from .intervals import runs

    rows = rank_of(samples, keys, t, [], "_i", width)
    flat = runs(rows.select(*keys, F.col("_i").alias("_t"), value), keys, "_t", value, None)
    around = previous(previous(flat, keys, "start", [], {"_p": value}), keys, "start", [], {"_n": value}, backward=True)
    peaks = around.filter((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n"))).select(*keys, F.floor((F.col("start") + F.col("stop")) / 2).alias("_i"))
    return rows.join(peaks, [*keys, "_i"]).select(*keys, t, value)


#: Parts in which a pass counts a unit's ranks, ranks that may be left to be rows, events of a cell, and tasks of a pass.
RANK_BINS, RANK_ROWS, CELL_EVENTS, RANK_TASKS = 16, 1 << 24, 4096, 24


def rank_in_events(spikes: DataFrame, spans: DataFrame, t: str, width, least_units: int = 5) -> DataFrame:
    """O-WIN-20: unit, rank_order, n_events: median over events of the unit's rank by first spike over the number of its units; events with fewer units don't count.

    Events meet the spikes that their spans reach in cells of four widths, and are ranked there in arrays. Medians take passes over the cells: each counts
    a unit's ranks in parts of the range that holds its median, RANK_BINS numbers a unit and task, until no more than RANK_ROWS ranks are left in those
    ranges or a pass no longer halves them. Only these become rows. What the driver holds is a few numbers a unit.
    """
    import numpy as np
    import pyarrow as pa

    from .ordered import bucket_of, range_join
    from .units import _coded, _lists, added

    units = checkpointed(spikes.select("unit").distinct().withColumn("_u", F.row_number().over(Window.orderBy("unit")) - 1))  # a row a unit
    n_units = units.count()
    points = spikes.filter(F.col(t).isNotNull()).select(F.col("unit").alias("_unit"), F.col(t).alias("_t")).join(units, F.col("_unit").eqNullSafe(F.col("unit"))).select("_u", "_t")
    events = spans.filter(F.col("start") <= F.col("stop")).select("event", "start", "stop", F.min("start").over(Window.partitionBy("event")).alias("_low")).withColumn("_cell", bucket_of("_low", 4 * width))
    parts = events.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / CELL_EVENTS).alias("_parts"))
    events = checkpointed(events.join(parts, "_cell").select("_cell", F.pmod(F.xxhash64("event"), F.col("_parts")).alias("_part"), "event", "start", "stop"))
    reach = events.groupBy("_cell", "_part").agg(F.min("start").alias("_from"), F.max("stop").alias("_to"))
    hits = range_join(points, reach, [], "_t", "_from", "_to", 4 * width)
    none = lambda c: F.lit(None).cast(events.schema[c].dataType).alias(c)
    both = hits.select("_cell", "_part", "_u", "_t", none("stop"), none("event")).union(events.select("_cell", "_part", F.lit(-1), "start", "stop", "event"))

    def pack(rows: pa.Table) -> pa.Table:
        """A cell in one row: units of spikes in order, the first place of each spike's time, and from, to, event of spans."""
        u, at = rows.column("_u").to_numpy(), rows.column("_t").to_numpy()
        own, span = np.flatnonzero(u >= 0), np.flatnonzero(u < 0)
        own = own[np.argsort(at[own], kind="stable")]
        x, event = at[own], _coded(rows.column("event").take(pa.array(span)))[0]
        order = np.argsort(event, kind="stable")
        span = span[order]
        stop = rows.column("stop").take(pa.array(span)).to_numpy()
        cells = [u[own], np.searchsorted(x, x, "left"), np.searchsorted(x, at[span], "left"), np.searchsorted(x, stop, "right"), event[order]]
        return pa.Table.from_arrays([_lists(c.astype(np.int32)[None, :]) for c in cells], names=["u", "same", "low", "high", "event"])

    cells = both.repartition(RANK_TASKS, "_cell", "_part").groupBy("_cell", "_part").applyInArrow(pack, "u array<int>, same array<int>, low array<int>, high array<int>, event array<int>")
    cells = checkpointed(cells).coalesce(RANK_TASKS)

    def ranked(batches):
        """Units and ranks over the number of units, of many events at a time."""
        codes, ranks, sizes, held = [], [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                code, same, low, high, event = (batch.column(c)[i].values.to_numpy() for c in ("u", "same", "low", "high", "event"))
                by, before = np.argsort(code, kind="stable"), np.full(len(code), -1, dtype=np.int32)
                before[by[1:]] = np.where(code[by[1:]] == code[by[:-1]], by[:-1], -1)
                starts = np.flatnonzero(np.diff(event, prepend=-1))
                for s, e in zip(starts.tolist(), np.append(starts, len(event))[1:].tolist(), strict=True):
                    if e == s + 1:
                        lo = int(low[s])
                        new = before[lo : high[s]] < lo
                        first = np.flatnonzero(new)
                        if len(first) < max(least_units, 1):
                            continue
                        seen = np.cumsum(new, dtype=np.int32)
                        seen -= new
                        first += lo
                        rank = seen[same[first] - lo] + 1
                    else:  # an event of several spans
                        at = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(low[s:e], high[s:e], strict=True)]))
                        first = at[np.sort(np.unique(code[at], return_index=True)[1])]
                        if len(first) < max(least_units, 1):
                            continue
                        rank = np.searchsorted(same[first], same[first], "left") + 1
                    codes.append(code[first])
                    ranks.append(rank)
                    sizes.append(len(first))
                    held += len(first)
                    if held >= 1 << 16:  # arrays that stay in the cache
                        yield np.concatenate(codes), np.concatenate(ranks) / np.repeat(sizes, sizes)
                        codes, ranks, sizes, held = [], [], [], 0
        if held:
            yield np.concatenate(codes), np.concatenate(ranks) / np.repeat(sizes, sizes)

    low, shift = np.zeros(n_units, dtype=np.int64), np.full(n_units, 26, dtype=np.int64)  # ranges of RANK_BINS << shift from low on, in parts of 2 ** 30
    lower = upper = None  # numbers of the median's two values within the range

    def part_of(code, r):
        """The part of its unit's range that a rank is in; beyond the range it is RANK_BINS or more."""
        part = (r * (1 << 30)).astype(np.int64)
        np.minimum(part, (1 << 30) - 1, out=part)
        part -= low[code]
        part >>= shift[code]
        return part.view(np.uint64)

    def count(batches):
        total = np.zeros(n_units * RANK_BINS, dtype=np.int64)
        places, held = [], 0
        for code, r in ranked(batches):
            part = part_of(code, r)
            place = code * np.int64(RANK_BINS) + part.view(np.int64)
            inside = part < RANK_BINS
            places.append(place if inside.all() else place[inside])
            held += len(places[-1])
            if held >= 1 << 21:
                total += np.bincount(np.concatenate(places), minlength=len(total))
                places, held = [], 0
        if held:
            total += np.bincount(np.concatenate(places), minlength=len(total))
        total = total.reshape(-1, RANK_BINS)
        hit = np.flatnonzero(total.any(axis=1))
        for s in range(0, len(hit), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(hit[s : s + (1 << 16)].astype(np.int32)), _lists(total[hit[s : s + (1 << 16)]])], names=["_u", "n"])

    def narrow(batches):
        for batch in batches:
            code = batch.column("_u").to_numpy()
            n = batch.column("n").flatten().to_numpy(zero_copy_only=False).reshape(-1, RANK_BINS)
            upto, size = n.cumsum(axis=1), n.sum(axis=1)
            k = [(size - 1) // 2, size // 2] if lower is None else [lower[code], upper[code]]
            first, last = ((upto <= x[:, None]).sum(axis=1) for x in k)
            under = np.where(first > 0, upto[np.arange(len(n)), first - 1], 0)
            left = upto[np.arange(len(n)), last] - under
            step = shift[code] - 4 + np.ceil(np.log2(last - first + 1)).astype(np.int64)
            found = [code, low[code] + (first << shift[code]), np.maximum(step, 0), k[0] - under, k[1] - under, left, size]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["_u", "low", "shift", "lower", "upper", "left", "size"])

    left = n_events = None
    while True:
        found = added(cells.mapInArrow(count, "_u int, n array<long>"), ["_u"], RANK_BINS).mapInArrow(narrow, "_u int, low long, shift long, lower long, upper long, left long, size long").toArrow()
        at, column = found.column("_u").to_numpy(), lambda c: found.column(c).to_numpy()  # noqa: B023
        held = np.zeros((5, n_units), dtype=np.int64)
        held[:, at] = [column(c) for c in ("low", "shift", "lower", "upper", "size")]
        low, shift, lower, upper = held[:4]
        n_events = held[4] if n_events is None else n_events
        before, left = (left if left is not None else int(n_events.sum())), int(column("left").sum())
        if left <= RANK_ROWS or left > before / 2:
            break

    def rest(batches):
        for code, r in ranked(batches):
            inside = part_of(code, r) < RANK_BINS
            yield pa.RecordBatch.from_arrays([pa.array(code[inside]), pa.array(r[inside])], names=["_u", "r"])

    known = np.flatnonzero(n_events)
    medians = pa.table({"_u": known.astype(np.int32), "lower": lower[known], "upper": upper[known], "n_events": n_events[known]})
    medians = units.join(spikes.sparkSession.createDataFrame(medians), "_u")
    upto = F.sum("_n").over(Window.partitionBy("_u").orderBy("r"))  # a unit's different ranks in its range
    values = cells.mapInArrow(rest, "_u int, r double").groupBy("_u", "r").agg(F.count(F.lit(1)).alias("_n")).select("_u", "r", upto.alias("_upto")).join(medians, "_u")
    value = lambda k: F.min(F.when(F.col("_upto") > F.col(k), F.col("r")))
    return values.groupBy("_u").agg(F.first("unit").alias("unit"), ((value("lower") + value("upper")) / 2).alias("rank_order"), F.first("n_events").alias("n_events")).drop("_u")


def thin_evenly(rows: DataFrame, keys: list[str], t: str, keep: int, width=None) -> DataFrame:
    """O-WIN-21: `keep` evenly spaced rows of each key (all if it has no more): row i of n stays where floor(i * keep / n) steps."""
    ranked = rank_of(rows, keys, t, [], "_i", width)
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = lambda i: F.floor(i * keep / F.col("_n"))
    return ranked.join(total, keys).filter((F.col("_n") <= keep) | (step(F.col("_i")) > step(F.col("_i") - 1))).drop("_i", "_n")


def trials(track: DataFrame, keys: list[str], t: str, position: str, low: float, high: float, width=None) -> DataFrame:
    """O-WIN-22: start, stop of passages from below `low` to above `high`: each upward crossing of high with the last upward crossing of low before it; of trials with one end the latest start stays."""
    from .ordered import asof

    rows = previous(track, keys, t, [], {"_p": position}, width)
    begins = rows.filter((F.col("_p") <= low) & (F.col(position) > low)).select(*keys, t, F.col(t).alias("start"))
    ends = rows.filter((F.col("_p") <= high) & (F.col(position) > high)).select(*keys, t)
    found = asof(ends, begins, keys, t, ["start"], width).filter("start IS NOT NULL").withColumnRenamed(t, "stop")
    return found.groupBy(*keys, "start").agg(F.min("stop").alias("stop"))


def event_duration_states(states: DataFrame, keys: list[str], t: str, state: str, minimum: dict[int, int], order: list[tuple[int, int]], width=None) -> DataFrame:
    """O-WIN-12: rewrite passes in order: (state, replacement) rewrites runs of `state` with fewer rows than its minimum; runs are taken anew in each pass."""
    from .intervals import runs
    from .ordered import range_join

    rows = states
    for code, into in order:
        short = runs(rows.select(*keys, t, state), keys, t, state, width).filter((F.col(state) == code) & (F.col("n") < minimum[code])).select(*keys, "start", "stop")
        hit = range_join(rows.select(*keys, t), short, keys, t, "start", "stop", width or 1 << 40).select(*keys, t, F.lit(True).alias("_hit"))
        rows = checkpointed(rows.join(hit, [*keys, t], "left").withColumn(state, F.when(F.col("_hit"), F.lit(into)).otherwise(F.col(state))).drop("_hit"))
    return rows


def suppress_transitions(spans: DataFrame, keys: list[str], first: str, then: str, into: str, longest, width=None) -> DataFrame:
    """O-WIN-13: intervals (state, start, stop) in order; a `then` right after a `first` longer than `longest` becomes `into`, and the rewritten one counts as what comes before the next.

    After an interval of any other state nothing earlier matters: such intervals cut a key into the groups that are rewritten each by itself.
    """
    import pandas as pd

    rows = previous(spans, keys, "start", [], {"_p": "state"}, width)
    cut = F.when(F.col("_p").isin(first, then, into), 0).otherwise(1)
    rows = running(rows.withColumn("_new", cut), keys, "start", [], {"_group": F.col("_new")}, "sum", width).drop("_p", "_new")

    def rewrite(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start").reset_index(drop=True)
        states, before, length = [], None, 0
        for s, a, b in zip(pdf["state"], pdf["start"], pdf["stop"], strict=True):
            new = into if s == then and before == first and length > longest else s
            length = length + (b - a) if new == before else b - a
            states.append(new)
            before = new
        pdf["state"] = states
        return pdf.drop(columns="_group")

    return rows.groupBy(*keys, "_group").applyInPandas(rewrite, spans.schema)
