"""Best-fit packing of token sequences by large-item matching, planned on the histogram of lengths.

A length is a number from 1 to the capacity, so the whole corpus is a histogram of that many counts, whatever its size.
The driver plans on it: runs of equal bins instead of single bins. Each row then finds its place from its length and its
rank among the rows of that length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, arrow_limits, lean

CAPACITY = 4096
#: Ends each document.
END_ID = 1
#: Pieces of one length that are ranked together.
RANKED = 100_000
#: Words of each of the two generations in a worker's cache.
WORDS = 400_000

#: Fixed by the vocabulary file: what its pre-tokenizer takes as pieces (white space goes).
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of these characters only are normalised and cut here, with the library's ids for each word; others go through the library whole.
_PLAIN = regex.compile(r"[^\t\n -~À-ÿ]")


class Tokens:
    """Ids of texts as the tokenizers library gives them, with a cache of pieces."""

    def __init__(self, text: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        # words of _PLAIN characters in lower case are normal already: the same without the normalizer
        self.bare = Tokenizer.from_str(json.dumps(json.loads(text) | {"normalizer": None}))
        self.bare.no_truncation()
        self.bare.no_padding()
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a piece
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of new blank-free words, from the library in one text: blanks part pieces, and a piece ends with its one last token."""
        counts = [len(_PIECE.findall(w)) for w in words]
        ids = np.asarray(self.bare.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = np.append(0, np.flatnonzero(self.last[ids]) + 1)
        bounds = ends[np.append(0, np.cumsum(counts))].tolist()
        if bounds[-1] != len(ids):
            raise ValueError("the vocabulary doesn't mark the ends of pieces")
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, text: str) -> bytes:
        """Unsigned 32-bit little-endian ids."""
        if _PLAIN.search(text) or any(m in text for m in self.marks):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = text.lower().split()
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) >= WORDS:  # words seen since the last change of generation outlive this one
                self.known, self.older = {}, self.known
                found = [None] * len(words)
            missing = dict.fromkeys([w for w, ids in zip(words, found, strict=True) if ids is None])
            new = []
            for w in missing:
                missing[w] = ids = self.older.get(w)
                if ids is None:
                    new.append(w)
            for lo in range(0, len(new), 5000):
                missing.update(zip(new[lo : lo + 5000], self._learn(new[lo : lo + 5000]), strict=True))
            self.known.update(missing)
            found = [missing[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return b"".join(found)


_LOADED: dict[int, Tokens] = {}


def _tokens(shared) -> Tokens:
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokens(shared.value)
    return _LOADED[key]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lean
def _cut(batches, shared, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(shared)
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = tokens.encode(text.as_py() or "") + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns[: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as little-endian unsigned 32-bit numbers): each text's ids and END_ID, cut at the capacity."""
    arrow_limits(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, a few MB
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_cut, shared=shared, capacity=capacity, with_ids=with_ids), _PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, items a bin, first bin, offset), sorted by length and first rank.

    Lengths above a third of the capacity fit at most twice into a bin: from the longest on, each is matched with the
    longest other that still fits. Shorter ones, from the longest on, go where the least room remains (best fit), new bins
    last. Bins with equal contents are handled at once: a step uses up a length or a run of bins, so their number depends on the capacity, not on the number of items.
    """
    left, rank = {s: n for s, n in counts.items() if n}, dict.fromkeys(counts, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    rooms, bins = 0, 0

    def put(size: int, n_bins: int, each: int, first: int, offset: int) -> None:
        runs.append((size, rank[size], each, first, offset))
        rank[size] += n_bins * each
        left[size] -= n_bins * each

    def leave(gap: int, first: int, n_bins: int) -> None:
        nonlocal rooms
        if gap and n_bins:
            room.setdefault(gap, []).append((first, n_bins))
            rooms |= 1 << gap

    large = [s for s in sorted(left, reverse=True) if 3 * s > capacity]
    waiting = sum(1 << s for s in large)
    for size in large:
        while left[size]:
            mate = (waiting & ((1 << (capacity - size + 1)) - 1)).bit_length() - 1
            if mate == size and left[size] == 1:
                mate = (waiting & ((1 << size) - 1)).bit_length() - 1
            if mate < 1:
                n = left[size]
                put(size, n, 1, bins, 0)
            elif mate == size:
                n = left[size] // 2
                put(size, n, 2, bins, 0)
            else:
                n = min(left[size], left[mate])
                put(size, n, 1, bins, 0)
                put(mate, n, 1, bins, size)
                if not left[mate]:
                    waiting &= ~(1 << mate)
            leave(capacity - size - max(mate, 0), bins, n)
            bins += n
        waiting &= ~(1 << size)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            fitting = rooms >> size
            if fitting:
                gap = size + (fitting & -fitting).bit_length() - 1
                first, n = room[gap].pop()
                if not room[gap]:
                    rooms &= ~(1 << gap)
            else:
                gap, first = capacity, bins
                n = -(-left[size] // (capacity // size))
                bins += n
            each = gap // size
            full = min(n, left[size] // each)
            if full:
                put(size, full, each, first, capacity - gap)
                leave(gap - each * size, first, full)
            if full < n:
                some = left[size]
                if some:
                    put(size, 1, some, first + full, capacity - gap)
                    leave(gap - some * size, first + full, 1)
                if gap < capacity or n - full > 1:
                    leave(gap, first + full + bool(some), n - full - bool(some))
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


@lean
def _place(batches, runs) -> Iterator[pa.RecordBatch]:
    size, rank, each, first, offset = runs.value.T
    top = np.int64(1) << 50
    starts = size * top + rank
    for batch in batches:
        length, at = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        i = np.searchsorted(starts, length * top + at, side="right") - 1
        nth = at - rank[i]
        cells = [*(batch.column(c) for c in batch.schema.names if c != "rank"), pa.array(first[i] + nth // each[i]), pa.array(offset[i] + nth % each[i] * length)]
        yield pa.RecordBatch.from_arrays(cells, [*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])


def pack(parts: DataFrame, stage: Stage, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, length and any other columns) with sequence_id and offset.

    Every part has 1 to `capacity` tokens; parts of a sequence lie side by side from 0. Parts of equal length are
    interchangeable, so null or repeated ids need no care. An empty table gives an empty one.
    """
    parts = stage.write(parts, "parts", scan=True)
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    if any(not 1 <= s <= capacity for s in histogram):
        raise ValueError("a length is out of range")
    runs = parts.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    # rows of one length are ranked in groups of about RANKED rows
    groups = F.broadcast(parts.sparkSession.createDataFrame([(s, -(-n // RANKED)) for s, n in histogram.items()], "length long, _groups long"))  # at most capacity rows
    salted = parts.join(groups, "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_groups"))).drop("_groups")
    counts = stage.write(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "counts", few=True)
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("rank", (F.col("rank") + F.col("_before")).cast("long"))
    ranked = ranked.select(*parts.columns, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(partial(_place, runs=runs), schema)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """pieces() and pack() in one: a row for each piece, null text as empty (END_ID alone). Other columns are not read."""
    return pack(pieces(docs, path, id_col, text_col, capacity, with_ids), Stage(docs.sparkSession), capacity)
