"""Substring dedup over a log-structured index of window fingerprints.

Each input partition (a block) turns its texts into one sorted immutable run: for every bucket of the hash space the
distinct fingerprints in order, and beside them the places they came from. Runs of a bucket are merge-joined with each
other and with the history; what occurs more than once goes back to its block as a mask, so a fingerprint that a third
of all texts holds costs the merge one entry a block. Merged runs are what compaction keeps as history for the next batch.

Two indexes of this kind follow each other. The first holds a sample of the windows' hashes: of the n-grams in a window
the least by hash, its anchor. Equal windows have equal anchors, so windows with an anchor that nothing shares drop out
and no repeat is lost; different grams with one hash only let more windows through. The second verifies the windows left by
their very words: it holds the 128-bit BLAKE2 digest of a window's words joined by one space, the first half as fingerprint
and the second as its check. Among 10**13 different windows two agree on both with a chance below 10**-12.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from . import arrowtext as at
from .common import Stage, arrow_limits, free_shuffles, lean

WINDOW = 35
#: Words of an anchor: 26 of them begin in a window of 35 words, so about 2 of 27 words begin an anchor.
GRAM = 10

_GRAMS = at.Powers(0xA0761D6478BD642F)
#: Text bytes for each bucket of the hash space; the merge of a bucket holds the fingerprints of about as much text.
BUCKET_BYTES = 256 << 20

_RUN = "block long, bucket int, prints binary, checks binary, many binary, n_refs binary, refs binary"


def _u32(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint32)


def _inside(w: at.Words, n: int, count: int) -> np.ndarray:
    """Of the first count words: whether n words from there on lie within one document."""
    last = np.repeat(w.first[1:], np.diff(w.first))[:count]
    return np.arange(count) + n <= last


def _window_anchors(w: at.Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the anchor (a word's number) of each, and the hashes of all grams."""
    grams = at.runs_of(hashes, gram, _GRAMS)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # of equal ones the first
    least = at.sliding_min(key, window - gram + 1)
    starts = np.flatnonzero(_inside(w, window, len(least)))
    return starts, (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), grams


def _digests(w: at.Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows at these words: the two halves of the digest of their words joined by one space."""
    if not len(starts):
        return (np.zeros(0, dtype=np.uint64),) * 2
    # every word followed by one space: a copy of the bytes without the other blanks
    size = w.end - w.start
    edge = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(edge[-1], 0x20, dtype=np.uint8)
    inside = np.ones(edge[-1], dtype=bool)
    inside[edge[1:] - 1] = False
    taken = np.zeros(len(w.bytes) + 1, dtype=np.int8)
    taken[w.start] += 1
    taken[w.end] -= 1  # a word may begin where the last text's word ends
    joined[inside] = w.bytes[np.cumsum(taken[:-1], dtype=np.int8).view(bool)]
    view = memoryview(joined.tobytes())
    blake = hashlib.blake2b
    found = b"".join([blake(view[a:b], digest_size=16).digest() for a, b in zip(edge[starts].tolist(), (edge[starts + window] - 1).tolist(), strict=True)])
    halves = np.frombuffer(found, dtype="<u8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


class _Run:
    """Collects one block's fingerprints and where they are."""

    def __init__(self):
        self.keys: dict[bytes, int] = {}
        self.times: list[int] = []
        self.prints, self.checks, self.owner, self.place = [], [], [], []

    def fresh(self, keys: list[bytes]) -> list[int]:
        """Which of the texts were not in this block before; repeats are only counted."""
        new = []
        for i, key in enumerate(keys):
            k = self.keys.setdefault(key, len(self.keys))
            if k == len(self.times):
                self.times.append(1)
                new.append(i)
            else:
                self.times[k] += 1
        return new

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        schema = ["block", "bucket", "prints", "checks", "many", "n_refs", "refs"]
        kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 5
        if not self.prints:
            return
        prints, checks, owner, place = (np.concatenate(x) for x in (self.prints, self.checks, self.owner, self.place))
        order = np.lexsort((checks, prints))
        prints, checks, owner, place = prints[order], checks[order], owner[order], place[order]
        new = np.ones(len(prints), dtype=bool)
        new[1:] = (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1])
        at_new = np.flatnonzero(new)
        n_refs = np.diff(np.append(at_new, len(prints)))
        times = np.add.reduceat(np.asarray(self.times)[owner], at_new)
        refs = np.stack([_u32(owner), _u32(place)], axis=1)
        which = (prints[at_new] >> np.uint64(32)).astype(np.int64) * buckets >> 32
        cuts = np.searchsorted(which, np.arange(buckets + 1))
        ref_cuts = np.append(at_new, len(prints))
        for b in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[b], cuts[b + 1]
            cells = [
                prints[at_new[lo:hi]].tobytes(), checks[at_new[lo:hi]].tobytes(), np.packbits(times[lo:hi] > 1).tobytes(),
                _u32(n_refs[lo:hi]).tobytes(), refs[ref_cuts[lo] : ref_cuts[hi]].tobytes(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([block, int(b), *cells], kinds, strict=True)], schema)
        names = [b"".join(self.keys), b"", b"", b"", b""]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([block, -1, *names], kinds, strict=True)], schema)


def _block() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


@lean
def _anchor_run(batches, window: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    run = _Run()
    for batch in batches:
        new = run.fresh(batch.column(0).to_pylist())
        owners = np.array([run.keys[k] for k in batch.column(0).take(pa.array(new, pa.int32())).to_pylist()], dtype=np.int64)
        for w in at.words(batch.column(1).take(pa.array(new, pa.int32()))):
            _, anchors, grams = _window_anchors(w, at.word_hashes(w), window, gram)
            anchors = np.unique(anchors)
            doc = w.doc()[anchors]
            run.prints.append(grams[anchors])
            run.checks.append(np.zeros(len(anchors), dtype=np.uint64))
            run.owner.append(owners[w.lo + doc])
            run.place.append(anchors - w.first[doc])
    yield from run.rows(_block(), buckets)


def _merge(table: pa.Table) -> pa.Table:
    """The runs of one bucket, merged: of each block's run the mask of what occurs again, and (block -1) the merged run."""
    prints, cuts = at.unpack(table["prints"].combine_chunks(), np.uint64)
    checks, _ = at.unpack(table["checks"].combine_chunks(), np.uint64)
    many = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=n) for x, n in zip(table["many"], np.diff(cuts), strict=True)] or [np.zeros(0, np.uint8)]).astype(bool)
    order = np.argsort(prints, kind="stable")
    same = prints[order[1:]] == prints[order[:-1]]
    if (checks[order[1:]] != checks[order[:-1]])[same].any():  # two windows that agree on one hash only
        order = np.lexsort((checks, prints))
    p, c = prints[order], checks[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    again = (np.bincount(group) > 1) | (np.bincount(group, weights=many[order]) > 0)
    mask = np.empty(len(p), dtype=bool)
    mask[order] = again[group]
    bucket = table["bucket"][0].as_py()
    blocks = table["block"].to_pylist()
    hits = [np.packbits(mask[lo:hi]).tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    rows = [(b, bucket, b"", b"", h, 0) for b, h in zip(blocks, hits, strict=True) if b >= 0]
    rows.append((-1, bucket, p[new].tobytes(), c[new].tobytes(), np.packbits(again).tobytes(), int(new.sum())))
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["block", "bucket", "prints", "checks", "many", "n"])


def _merge_masks(table: pa.Table) -> pa.Table:
    merged = _merge(table)
    return merged.filter(pc.greater_equal(merged["block"], 0)).select(["block", "bucket", "many"])


def _merge_history(table: pa.Table) -> pa.Table:
    merged = _merge(table)
    return merged.filter(pc.less(merged["block"], 0)).select(["block", "bucket", "prints", "checks", "many"])


def _hits(run: pa.Table, masks: pa.Table) -> pa.Table:
    """Of one block: a row for each text with repeats, with their places in order."""
    mask = dict(zip(masks["bucket"].to_pylist(), masks["many"].to_pylist(), strict=True))
    keys, found = b"", []
    for bucket, prints, n_refs, refs in zip(*(run[c].to_pylist() for c in ("bucket", "prints", "n_refs", "refs")), strict=True):
        if bucket < 0:
            keys = prints
            continue
        n = np.frombuffer(n_refs, dtype=np.uint32)
        again = np.unpackbits(np.frombuffer(mask[bucket], dtype=np.uint8), count=len(n)).astype(bool)
        if again.any():
            found.append(np.frombuffer(refs, dtype=np.uint32).reshape(-1, 2)[np.repeat(again, n)])
    if not found:
        return pa.table([pa.array([], pa.binary())] * 2, names=["key", "places"])
    refs = np.concatenate(found)
    refs = refs[np.lexsort((refs[:, 1], refs[:, 0]))]
    first = np.flatnonzero(np.append(True, refs[1:, 0] != refs[:-1, 0]))
    names = [keys[16 * i : 16 * i + 16] for i in refs[first, 0].tolist()]
    return pa.table([pa.array(names, pa.binary()), at.pack(refs[:, 1], np.append(first, len(refs)))], names=["key", "places"])


def _repeats(stage: Stage, runs: DataFrame, history: DataFrame | None, name: str) -> DataFrame:
    """key, places: the repeated fingerprints of each text, from the staged runs and the history's."""
    narrow = runs.filter("bucket >= 0").select("block", "bucket", "prints", "checks", "many")
    narrow = narrow if history is None else narrow.unionByName(history)
    masks = narrow.groupBy("bucket").applyInArrow(_merge_masks, "block long, bucket int, many binary")
    hits = runs.select("block", "bucket", "prints", "n_refs", "refs").withColumn("prints", F.expr("if(bucket < 0, prints, null)"))
    hits = hits.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(_hits, "key binary, places binary")
    # the same text in other blocks has the same repeats
    return stage.write(hits.groupBy("key").agg(F.first("places").alias("places")), name, few=True)


def _finished(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_OPEN = "kind string, doc_id long, key binary, text string, n_words long, kept_sha256 string, " + _RUN


@lean
def _open_or_done(batches, window: int, gram: int, buckets: int, carried, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows done: texts without a shared anchor, finished. Rows open: the others, as they are. Rows run: their windows.

    carried is the Arrow type of the column carry, which goes along with its row.
    """
    run = _Run()
    names = [x.split()[0] for x in _OPEN.split(", ")] + ["carry"]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = {x.split()[0]: kinds[x.split()[1]] for x in _OPEN.split(", ")} | {"carry": carried}

    def out(n: int, **cells) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cells[c], types[c]) if c in cells and not isinstance(cells[c], pa.Array) else cells.get(c, pa.nulls(n, types[c])) for c in names], names=names)

    for batch in batches:
        ids, keys, texts, places, carry = (batch.column(c) for c in ("doc_id", "key", "text", "places", "carry"))
        alone = pc.is_null(places)
        done = [x.as_py() for x in texts.filter(alone)]
        words = [(x or "").encode().split() for x in done]
        if done:
            yield out(len(done), kind=["done"] * len(done), doc_id=ids.filter(alone), **({"text": texts.filter(alone)} if with_text else {}), n_words=[len(x) for x in words], kept_sha256=[_finished(x) for x in words], carry=carry.filter(alone))
        shared = pc.is_valid(places)
        if not pc.any(shared).as_py():
            continue
        ids, keys, texts, places, carry = (x.filter(shared) for x in (ids, keys, texts, places, carry))
        yield out(len(ids), kind=["open"] * len(ids), doc_id=ids, key=keys, text=texts, carry=carry)
        new = pa.array(run.fresh(keys.to_pylist()), pa.int32())
        owners = np.array([run.keys[k] for k in keys.take(new).to_pylist()], dtype=np.int64)
        shared_at, cuts = at.unpack(places.take(new), np.uint32)
        for w in at.words(texts.take(new)):
            hashes = at.word_hashes(w)
            starts, anchors, _ = _window_anchors(w, hashes, window, gram)
            wanted = np.zeros(len(w) + 1, dtype=bool)
            lo, hi = cuts[w.lo], cuts[w.hi]
            wanted[np.repeat(w.first[:-1], np.diff(cuts[w.lo : w.hi + 1])) + shared_at[lo:hi]] = True
            starts = starts[wanted[anchors]]
            doc = w.doc()[starts]
            prints, checks = _digests(w, starts, window)
            run.prints.append(prints)
            run.checks.append(checks)
            run.owner.append(owners[w.lo + doc])
            run.place.append(starts - w.first[doc])
    for row in run.rows(_block(), buckets):
        yield out(1, kind=["run"], **{c: row.column(i) for i, c in enumerate(row.schema.names)})


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Of n words: whether a window of that many words with one of the starts covers it."""
    edge = np.zeros(n + window + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:n] > 0


@lean
def _remove(batches, window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
            words = (text.as_py() or "").encode().split()
            gone = covered(np.frombuffer(places.as_py() or b"", dtype=np.uint32).astype(np.int64), len(words), window)
            kept = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(_finished(kept))
            kept_texts.append((b" ".join(kept) if n_removed[-1] else (text.as_py() or "").encode()).decode() if with_text else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string()), batch.column("carry")], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "carry"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, history: DataFrame | None = None, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null unless with_text), carry (a struct of the columns named so, null without): a row for each row of docs.

    A word goes if a window of that many words covers it whose words also start anywhere else, in this or another text,
    or are in the history (fingerprint_history() of earlier batches). A null or empty text has no words; its digest is
    that of no bytes. Rows are told apart by text, so null and repeated ids are fine; a repeated row repeats all its
    windows. Other columns are not read. An untouched text is returned as it is, a touched one as its kept words.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    stage = Stage(spark)
    buckets = _buckets(docs, text_col, history)
    text = F.coalesce(F.col(text_col), F.lit(""))
    along = F.struct(*carry) if carry else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"), along.alias("carry"))
    kind = source.schema["carry"].dataType
    runs = stage.write(source.select("key", "text").mapInArrow(partial(_anchor_run, window=window, gram=gram, buckets=buckets), _RUN), "anchors")
    shared = _repeats(stage, runs, None if history is None else _level(history, 1), "shared")
    stage.drop("anchors")
    free_shuffles(spark)
    second = source.join(shared, "key", "left").mapInArrow(partial(_open_or_done, window=window, gram=gram, buckets=buckets, carried=to_arrow_type(kind), with_text=with_text), StructType.fromDDL(_OPEN).add("carry", kind))
    tables = stage.write(second, "windows")
    free_shuffles(spark)
    windows = tables.filter("kind = 'run'").select(*[x.split()[0] for x in _RUN.split(", ")])
    repeats = _repeats(stage, windows, None if history is None else _level(history, 2), "repeats")
    free_shuffles(spark)
    done = tables.filter("kind = 'done'").selectExpr("doc_id", "n_words", "0L as n_removed", "kept_sha256", "text as kept_text" if with_text else "cast(null as string) as kept_text", "carry")
    left = tables.filter("kind = 'open'").select("doc_id", "key", "text", "carry").join(repeats, "key", "left")
    removed = left.select("doc_id", "text", "places", "carry").mapInArrow(partial(_remove, window=window, with_text=with_text), StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string").add("carry", kind))
    return done.unionByName(removed)


def _buckets(docs: DataFrame, text_col: str, history: DataFrame | None) -> int:
    """The history's number of buckets; without one, as many as the texts' bytes ask for."""
    if history is not None and (kept := history.agg(F.min("buckets"), F.max("buckets")).first()) and kept[0] is not None:
        if kept[0] != kept[1]:
            raise ValueError(f"runs of {kept[0]} and of {kept[1]} buckets in one history: merge them by fingerprint_history first")
        return kept[0]
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def _level(history: DataFrame, level: int) -> DataFrame:
    return history.filter(F.col("level") == level).drop("level", "buckets")


@lean
def _all_windows_run(batches, window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    run = _Run()
    for batch in batches:
        new = pa.array(run.fresh(batch.column(0).to_pylist()), pa.int32())
        owners = np.array([run.keys[k] for k in batch.column(0).take(new).to_pylist()], dtype=np.int64)
        for w in at.words(batch.column(1).take(new)):
            starts = np.flatnonzero(_inside(w, window, max(len(w) - window + 1, 0)))
            prints, checks = _digests(w, starts, window)
            run.prints.append(prints)
            run.checks.append(checks)
            run.owner.append(owners[w.lo + w.doc()[starts]])
            run.place.append(starts)
    yield from run.rows(_block(), buckets)


def fingerprint_history(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, history: DataFrame | None = None) -> DataFrame:
    """level, buckets, block (-1), bucket, prints, checks, many: the merged runs of docs and an earlier history, one a bucket.

    Write it as a table; it is what remove_repeats() takes as history. It carries its number of buckets, which later batches
    and compactions take over whatever the session's settings are. Null and empty texts add nothing.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    buckets = _buckets(docs, text_col, history)
    source = docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    levels = []
    for level, build in ((1, partial(_anchor_run, window=window, gram=gram, buckets=buckets)), (2, partial(_all_windows_run, window=window, buckets=buckets))):
        runs = source.mapInArrow(build, _RUN).filter("bucket >= 0").select("block", "bucket", "prints", "checks", "many")
        if history is not None:
            runs = runs.unionByName(_level(history, level))
        merged = runs.groupBy("bucket").applyInArrow(_merge_history, "block long, bucket int, prints binary, checks binary, many binary")
        levels.append(merged.select(F.lit(level).alias("level"), F.lit(buckets).cast("long").alias("buckets"), "*"))
    return levels[0].unionByName(levels[1])
