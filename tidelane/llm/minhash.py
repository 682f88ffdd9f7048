"""Near-duplicate detection: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Steps: (1) a signature of each text's distinct word shingles; (2) texts with equal shingle sets become one class, by its
least id; (3) each band of a signature is a bucket, whose members are paired with one hub only; (4) candidate pairs are
confirmed on full sets, best first, and only while their ends are not yet known to be connected; (5) components.

A bucket's hub is the member with the least hash of (member, bucket): other buckets of the same family have other hubs, so a
text is compared with about as many members of its family as there are bands. A star misses a link between two members
that are both unlike the hub. So texts of buckets that end up in more than one component go through an exact search
(leftovers): their shingles are put in one order, rarest first, and two texts of different components are compared if some
shared shingle leaves room for enough others behind it in both. Every pair that is similar enough has such a shingle, its
first common one, so nothing that the buckets brought together is lost, whatever the layout of the files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrowtext as at
from .common import Stage, arrow_limits, free_shuffles, lean
from .components import components

SHINGLE = 5
PERCENT = 80
#: BANDS x ROWS values: two texts of similarity 0.8 share no band with a chance of (1 - 0.8**ROWS)**BANDS = 1e-8.
BANDS, ROWS = 60, 6
#: Texts that hold one shingle, in a part of its list; a longer list is dealt into parts.
LIST_PART = 4096
#: Independent one-permutation hashes that a signature's values are dealt from. The rows of a band come from different
#: ones, so that the few shingles of a short text don't fill a band twice.
PERMUTATIONS = ROWS

_SHINGLES, _SECOND = at.Powers(0xC2B2AE3D27D4EB4F), at.Powers(0x8EBC6AF09C88C6E3)
_SALT = np.uint64(0x589965CC75374CC3)
_SEEDS = at.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_BAND_SEEDS = at.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _draws(tries: int) -> np.ndarray:
    """Of bin and try: the bin to borrow from, the same for all texts."""
    bins, turn = np.meshgrid(np.arange(BANDS, dtype=np.uint64), np.arange(tries, dtype=np.uint64), indexing="ij")
    return (at.mix(bins * np.uint64(0x9E3779B97F4A7C15) + turn * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) % np.uint64(BANDS)).astype(np.int64)


_TRIES = 1024
_DRAWS = _draws(_TRIES)


def _densify(bins: np.ndarray) -> np.ndarray:
    """Optimal densification: an empty bin takes the value of the first full bin among its own random draws."""
    full = bins != _EMPTY
    todo = np.argwhere(~full & full.any(axis=1)[:, None])
    out = bins.copy()
    for t in range(_TRIES):
        if not len(todo):
            break
        source = _DRAWS[todo[:, 1], t]
        hit = full[todo[:, 0], source]
        out[todo[hit, 0], todo[hit, 1]] = bins[todo[hit, 0], source[hit]]
        todo = todo[~hit]
    for row, b in todo:  # never seen: 1024 draws all from empty bins
        out[row, b] = bins[row, np.flatnonzero(full[row])[b % full[row].sum()]]
    return out


def shingle_sets(values: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """lo, hi, hashes, others, bounds: the distinct shingles of rows lo to hi as sorted 64-bit hashes, and a second hash of each."""
    for w in at.words(values, lower=True):
        hashes = at.word_hashes(w)
        other = at.mix(hashes ^ _SALT)
        count = np.diff(w.first)
        n = w.hi - w.lo
        doc = w.doc()
        runs, more = at.runs_of(hashes, shingle, _SHINGLES), at.runs_of(other, shingle, _SECOND)
        starts = np.arange(len(runs))
        starts = starts[starts + shingle <= w.first[1:][doc[: len(runs)]]]
        parts, seconds, owners = [runs[starts]], [more[starts]], [doc[starts]]
        for i in np.flatnonzero((count > 0) & (count < shingle)):  # fewer words: the whole sequence is one shingle
            own = slice(w.first[i], w.first[i + 1])
            for found, numbers, powers in ((parts, hashes[own], _SHINGLES), (seconds, other[own], _SECOND)):
                found.append(at.mix(at.runs_of(numbers, len(numbers), powers) + np.uint64(len(numbers))))
            owners.append(np.array([i]))
        value, second, owner = np.concatenate(parts), np.concatenate(seconds), np.concatenate(owners)
        order = np.lexsort((value, owner))
        value, second, owner = value[order], second[order], owner[order]
        keep = np.ones(len(value), dtype=bool)
        keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, second, owner = value[keep], second[keep], owner[keep]
        yield w.lo, w.hi, value, second, np.searchsorted(owner, np.arange(n + 1))


def set_keys(value: np.ndarray, second: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each set's two hashes, null for empty sets."""
    raw, more = value.tobytes(), second.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b] + more[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def band_hashes(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of BANDS bucket numbers for each non-empty set, any for empty ones."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    out = np.tile(_BAND_SEEDS, (n, 1))
    for seed in _SEEDS:
        h = at.mix(value ^ seed)
        slot = owner * BANDS + ((h >> np.uint64(32)) * np.uint64(BANDS) >> np.uint64(32)).astype(np.int64)
        bins = np.full(n * BANDS, _EMPTY, dtype=np.uint64)
        order = np.argsort(slot, kind="stable")
        slot, h = slot[order], h[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        if len(first):
            bins[slot[first]] = np.minimum.reduceat(h, first)
        out = at.mix((out + _densify(bins.reshape(n, BANDS))) * np.uint64(0xFF51AFD7ED558CCD))
    return out


@lean
def _signatures(batches, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, value, second, bounds in shingle_sets(batch.column(1), shingle):
            bands = band_hashes(value, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), pa.array(set_keys(value, second, bounds), pa.binary()), at.pack(bands.ravel(), np.arange(hi - lo + 1) * BANDS)],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )


def _hub_order(docs: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return at.mix(at.mix(docs.astype(np.uint64)) ^ buckets)


_STAR = "bucket long, rank long, doc_id long, x long, hub long"


@lean
def _local_stars(batches) -> Iterator[pa.RecordBatch]:
    """Stars within this task's rows; of each bucket only the hub goes on, so a bucket costs the exchange one row a task."""
    buckets, docs = [], []
    for batch in batches:
        value, cuts = at.unpack(batch.column("bands"), np.uint64)
        buckets.append(value)
        docs.append(np.repeat(batch.column("doc_id").to_numpy(), np.diff(cuts)))
    if not buckets:
        return
    bucket, doc = np.concatenate(buckets), np.concatenate(docs)
    rank = _hub_order(doc, bucket)
    order = np.lexsort((rank, bucket))
    bucket, doc, rank = bucket[order], doc[order], rank[order]
    first = np.append(True, bucket[1:] != bucket[:-1])
    starts = np.flatnonzero(first)
    hub = doc[np.repeat(starts, np.diff(np.append(starts, len(bucket))))]
    pair = doc != hub
    n, m = len(starts), int(pair.sum())
    column = lambda a, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(np.ascontiguousarray(a).view(np.int64)), pa.nulls(after, pa.int64())])
    yield pa.RecordBatch.from_arrays([column(bucket[starts], 0, m), column(rank[starts], 0, m), column(doc[starts], 0, m), column(doc[pair], n, 0), column(hub[pair], n, 0)], ["bucket", "rank", "doc_id", "x", "hub"])


@lean
def _joined_stars(batches) -> Iterator[pa.RecordBatch]:
    """Pairs with the hub, of rows in order of (bucket, rank); a batch at a time."""
    last = hub = None
    for batch in batches:
        bucket, doc = batch.column("bucket").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(bucket):
            continue
        first = np.append(bucket[0] != last if last is not None else True, bucket[1:] != bucket[:-1])
        hubs = np.append(doc[:1] if hub is None else hub, doc[first])[np.cumsum(first)]
        last, hub = bucket[-1], hubs[-1]
        pair = doc != hubs
        yield pa.RecordBatch.from_arrays([pa.array(doc[pair]), pa.array(hubs[pair])], ["x", "hub"])


@lean
def _confirm(batches, shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough; shingles are equal if both of their hashes are."""
    for batch in batches:
        x_sets, hub_sets = [], []
        for column, sets in ((batch.column("x_text"), x_sets), (batch.column("hub_text"), hub_sets)):
            for _, _, value, second, bounds in shingle_sets(column, shingle):
                sets += [(value[a:b], second[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        good = []
        for (a, a2), (b, b2) in zip(x_sets, hub_sets, strict=True):
            both, second = np.concatenate([a, b]), np.concatenate([a2, b2])
            order = np.argsort(both, kind="stable")
            both, second = both[order], second[order]
            common = int(((both[1:] == both[:-1]) & (second[1:] == second[:-1])).sum())
            good.append(100 * common >= percent * (len(a) + len(b) - common) and common > 0)
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("hub"), pa.array(good, pa.bool_())], ["x", "hub", "linked"])


@lean
def _entries(batches) -> Iterator[pa.RecordBatch]:
    """bucket, doc_id, part."""
    for batch in batches:
        value, cuts = at.unpack(batch.column("bands"), np.uint64)
        each = np.diff(cuts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(value.view(np.int64)), pa.array(np.repeat(batch.column("doc_id").to_numpy(), each)), pa.array(np.repeat(batch.column("part").to_numpy(), each))],
            ["bucket", "doc_id", "part"],
        )


@lean
def _tokens(batches, shingle: int) -> Iterator[pa.RecordBatch]:
    """node (a number for each text), doc_id, part, size, and the text's shingles."""
    for batch in batches:
        for lo, hi, value, second, bounds in shingle_sets(batch.column("text"), shingle):
            columns = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "part")]
            ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
            nodes = [int.from_bytes(hashlib.blake2b(b"%d " % i + (k or b""), digest_size=8).digest(), "little", signed=True) for i, k in zip(ids, set_keys(value, second, bounds), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), *columns, pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))],
                ["node", "doc_id", "part", "size", "tokens"],
            )


def leftovers(bands: DataFrame, texts: DataFrame, stage: Stage, shingle: int, percent: int) -> DataFrame:
    """x, hub: every two texts of different components (part of bands' rows) in buckets of more than one component that may be similar enough.

    Sets A and B with at least percent of A | B in common share at least percent / (100 + percent) * (|A| + |B|) shingles. In one
    order of all shingles their first common one has as many behind it in both, itself included. Rarest first,
    texts of a family that differ in their own words reach shingles of the family too late for that. Of a shingle's texts,
    those of its most frequent component are not compared with each other.
    """
    percent = max(percent, 1)
    entries = bands.mapInArrow(_entries, "bucket long, doc_id long, part long")
    # of a bucket of two members each was compared with the other
    open_ = entries.groupBy("bucket").agg(F.min("part").alias("_a"), F.max("part").alias("_b"), F.count(F.lit(1)).alias("_n")).filter("_a != _b and _n > 2").select("bucket")
    members = stage.write(entries.join(open_, "bucket", "left_semi").select("doc_id", "part").distinct(), "open", few=True)
    sets = stage.write(members.join(texts, "doc_id").mapInArrow(partial(_tokens, shingle=shingle), "node long, doc_id long, part long, size long, tokens array<long>"), "sets")
    single = sets.select("node", "size", F.explode("tokens").alias("token"))
    often = single.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # behind: how many shingles of the text come no earlier than this one; those that no other text has come first of all
    ranked = single.join(often, "token").withColumn("behind", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), F.desc("token"))))
    early = ranked.filter(f"100 * behind >= {percent} * size").select("node", "token", "behind").join(sets.select("node", "doc_id", "part", "size"), "node")
    early = stage.write(early, "early", few=True)
    lists = early.groupBy("token", "part").agg(F.count(F.lit(1)).alias("_n"))
    lists = lists.groupBy("token").agg(F.sum("_n").alias("length"), F.max_by("part", F.struct("_n", "part")).alias("core"), F.count(F.lit(1)).alias("_parts")).filter("_parts > 1").drop("_parts")
    placed = early.join(lists, "token").withColumn("slices", F.ceil(F.col("length") / LIST_PART))
    placed = stage.write(placed, "placed", few=True)
    mine = placed.filter("part != core").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).alias("a")
    theirs = placed.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices"))).alias("b")
    room = F.least("a.behind", "b.behind") * (100 + percent) >= percent * (F.col("a.size") + F.col("b.size"))
    once = (F.col("b.part") == F.col("b.core")) | (F.col("a.doc_id") < F.col("b.doc_id"))
    pairs = mine.join(theirs, (F.col("a.token") == F.col("b.token")) & (F.col("a.slice") == F.col("b.slice")) & (F.col("a.part") != F.col("b.part")) & once & room)
    return pairs.select(F.greatest("a.doc_id", "b.doc_id").alias("x"), F.least("a.doc_id", "b.doc_id").alias("hub")).distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    Words are runs of bytes other than blanks, A-Z lower-cased; a text's set holds its distinct runs of `shingle` words,
    or with fewer words the whole sequence as one. Texts are linked if 100 * intersection >= percent * union; the
    component's number is the least id that is reachable, itself included; that row stays. Empty and null texts are linked
    with nothing. Ids must be unique among rows with words; a repeated id counts as one document with each of its texts.
    A row with a null id is linked with nothing, its component is null and it stays. Other columns are not read.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    stage = Stage(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage.write(source.mapInArrow(partial(_signatures, shingle=shingle), "doc_id long, n_shingles long, set_key binary, bands binary"), "signed", scan=True)
    rows = stage.write(signed.select("doc_id", "n_shingles", "set_key"), "rows", few=True)
    narrow = rows.filter("doc_id is not null and set_key is not null").select("doc_id", "set_key")
    classes = stage.write(narrow.groupBy("set_key").agg(F.min("doc_id").alias("doc_id")), "classes", few=True)
    bands = signed.select("doc_id", "set_key", "bands").join(classes, ["doc_id", "set_key"], "left_semi").select("doc_id", "bands")
    bands = stage.write(bands, "bands0", few=True)
    stage.drop("signed")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # candidate pairs: a star in each bucket
    local = stage.write(bands.mapInArrow(_local_stars, _STAR), "local")
    met = local.filter("x is null").select("bucket", "rank", "doc_id").repartition(partitions, "bucket").sortWithinPartitions("bucket", "rank").mapInArrow(_joined_stars, "x long, hub long")
    pairs = met.union(local.filter("x is not null").select("x", "hub")).groupBy(F.greatest("x", "hub").alias("x"), F.least("x", "hub").alias("hub")).agg(F.count(F.lit(1)).alias("shared"))
    pairs = stage.write(pairs, "pairs", few=True)
    stage.drop("local")
    # every member of a bucket with others is in a pair: no other text, nor its bands, is needed from here on
    ends = stage.write(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("hub")).distinct(), "ends", few=True)
    texts = stage.write(source.join(ends.hint("merge"), "doc_id", "left_semi"), "texts")
    bands = stage.write(bands.join(ends, "doc_id", "left_semi"), "met", few=True)
    stage.drop("bands0")
    free_shuffles(spark)

    def confirm(chosen: DataFrame, name: str) -> DataFrame:
        pair = chosen.select("x", "hub").join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("x_text")).hint("merge"), "x")
        pair = pair.join(texts.select(F.col("doc_id").alias("hub"), F.col("text").alias("hub_text")).hint("merge"), "hub")
        found = stage.write(pair.select("x", "hub", "x_text", "hub_text").mapInArrow(partial(_confirm, shingle=shingle, percent=percent), "x long, hub long, linked boolean"), name)
        free_shuffles(spark)
        return found

    def join_up(held: DataFrame, before: DataFrame | None, name: str) -> DataFrame:
        new = held.filter("linked").select(F.col("x").alias("u"), F.col("hub").alias("v"))
        return components(new if before is None else new.union(before.select(F.col("node").alias("u"), F.col("component").alias("v"))), stage, name)

    # first the best pair of each x; what it connects needs no further test
    best = confirm(pairs.groupBy("x").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub")), "held_best")
    parts = join_up(best, None, "cc_best")
    todo = pairs.join(best, ["x", "hub"], "left_anti")
    todo = todo.join(parts.select(F.col("node").alias("x"), F.col("component").alias("_x")), "x", "left").join(parts.select(F.col("node").alias("hub"), F.col("component").alias("_hub")), "hub", "left")
    rest = confirm(todo.filter("coalesce(_x, x) != coalesce(_hub, hub)"), "held_rest")
    parts = join_up(rest, parts, "cc_rest")
    # what the stars leave
    near = parts.select(F.col("node").alias("doc_id"), F.col("component"))
    bands = stage.write(bands.join(near, "doc_id", "left").select("doc_id", "bands", F.coalesce("component", "doc_id").alias("part")), "bands1", few=True)
    stage.drop("met")
    late = leftovers(bands, texts, stage, shingle, percent).join(best.select("x", "hub").union(rest.select("x", "hub")), ["x", "hub"], "left_anti")
    late = confirm(stage.write(late, "late", few=True), "held_late")
    parts = join_up(late, parts, "cc_late")
    found = classes.withColumnRenamed("doc_id", "node")
    found = found.join(parts, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    named = rows.filter("doc_id is not null and set_key is not null")
    found = stage.write(found, "found", few=True)
    stage.drop("texts", "pairs", "bands1", "open", "sets", "early", "placed", "late")
    joined = named.join(found, "set_key")  # two plain exchanges: Spark can split a hot set
    rest = rows.filter("doc_id is null or set_key is null").withColumn("component_id", F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", "component_id").union(rest.select("doc_id", "n_shingles", "component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
