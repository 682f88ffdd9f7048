"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, letters A-Z lowered, hashed into WORDS places, trigrams of character shapes hashed into SHAPES
places, and how its words repeat. A truncated singular value decomposition of the labelled texts' weighted terms gives the latent space. Each document's vector is compared
with all labelled vectors in blocked matrix products, and its NEIGHBOURS most similar ones vote with their labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .common import arrow_limits, lean, trim

#: Labelled texts of each class that the model is fitted on at most, chosen by a hash of their ids: this bounds the
#: driver's matrix (2 x FIT_ROWS x SIZE numbers) and the broadcast vectors, whatever the input's size.
FIT_ROWS = 1500
WORDS, SHAPES, REPEATS = 1024, 512, 8
SIZE = WORDS + SHAPES + REPEATS
LATENT = 48
NEIGHBOURS = 25
#: Weight of a neighbour: its similarity (0 if negative) to this power.
SHARPNESS = 8
#: Documents of one matrix product.
BLOCK = 512
THRESHOLD = 0.7

_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = ord(" ")
_SHAPE[128:] = ord("a")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that nothing is learnt from: the CRC-32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _shares_of(owner: np.ndarray, code: np.ndarray, n: int, size: int) -> np.ndarray:
    flat = np.bincount(owner * size + code.astype(np.int64), minlength=n * size).reshape(n, size)
    return np.sqrt(flat / np.maximum(flat.sum(axis=1, keepdims=True), 1))


def term_counts(values: pa.Array) -> np.ndarray:
    """A row of SIZE weights for each text: square roots of the terms' shares, words, shapes and repeats apart.

    The last REPEATS places say, for distances 1 to REPEATS, which share of the words equals the word so far back.
    A null or empty text has no terms and gives zeros.
    """
    out = np.zeros((len(values), SIZE), dtype=np.float32)
    for w, low in zip(at.words(values), at.words(values, lower=True), strict=True):
        n, rows = w.hi - w.lo, slice(w.lo, w.hi)
        shape = _SHAPE[w.bytes]
        if len(shape) >= 3:
            code = (shape[:-2] * np.uint32(0x01000193) ^ shape[1:-1]) * np.uint32(0x01000193) ^ shape[2:]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SHAPES.bit_length() + 1)
            owner = np.repeat(np.arange(n), _sizes(values, w.lo, w.hi))
            inside = owner[:-2] == owner[2:]
            out[rows, WORDS : WORDS + SHAPES] = _shares_of(owner[:-2][inside], code[inside], n, SHAPES)
        if len(w):
            hashes, doc = at.word_hashes(low), w.doc()
            out[rows, :WORDS] = _shares_of(doc, hashes >> np.uint64(64 - WORDS.bit_length() + 1), n, WORDS)
            for back in range(1, min(REPEATS, len(w) - 1) + 1):
                same = (hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back])
                out[rows, SIZE - REPEATS + back - 1] = np.sqrt(np.bincount(doc[back:][same], minlength=n) / np.maximum(np.diff(w.first), 1))
    return out


def _sizes(values: pa.Array, lo: int, hi: int) -> np.ndarray:
    _, offsets = at.column(values.slice(lo, hi - lo))
    return np.diff(offsets)


@dataclass(frozen=True)
class Model:
    """What is broadcast: its size depends on FIT_ROWS, SIZE and LATENT only."""

    mean: np.ndarray
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, terms: np.ndarray) -> np.ndarray:
        latent = ((terms - self.mean) * self.weight) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Weighted votes of the NEIGHBOURS most similar vectors. Similarities count to 6 digits; of equal ones the first vectors vote."""
        n = len(self.labels)
        if not n:
            return np.full(len(terms), 0.5)
        out = np.empty(len(terms))
        k = min(NEIGHBOURS, n)
        for lo in range(0, len(terms), BLOCK):
            similar = self.embed(terms[lo : lo + BLOCK].astype(np.float64)) @ self.vectors.T
            # whole numbers, no two of a row equal: which neighbours vote, and in which order, doesn't depend on the block
            order = np.rint(similar * 1e6).astype(np.int64) * n + np.arange(n - 1, -1, -1)
            best = -np.sort(np.partition(-order, k - 1, axis=1)[:, :k], axis=1)
            weight = np.maximum(best // n / 1e6, 0.0) ** SHARPNESS
            votes = self.labels[n - 1 - best % n]
            total = weight.sum(axis=1)
            out[lo : lo + BLOCK] = np.where(total > 0, (weight * votes).sum(axis=1) / np.maximum(total, 1e-30), votes.mean(axis=1))
        return np.round(np.clip(out, 0.0, 1.0), 5)


@lean
def _term_rows(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = term_counts(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), at.pack(terms.ravel(), np.arange(len(terms) + 1) * terms.shape[1]), batch.column(2)], ["doc_id", "terms", "label"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model from at most FIT_ROWS texts of each class; held-out rows, null labels and labels without a text are left out.

    An id that is labelled more than once counts with its greatest label, one that docs repeat with its least text.
    Without labelled texts every score is 0.5.
    """
    arrow_limits(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("label"))
    chosen = [known.filter(F.col("label") == v).orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS) for v in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 x FIT_ROWS rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(sample, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "label")
    got = rows.mapInArrow(_term_rows, "doc_id long, terms binary, label int").orderBy("doc_id").toArrow()
    terms, _ = at.unpack(got["terms"].combine_chunks(), np.float32)
    terms, votes = terms.reshape(-1, SIZE), got["label"].to_numpy().astype(np.float64)
    if not len(votes):
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros((SIZE, 1)), np.zeros((0, 1)), votes)
    found = (terms > 0).sum(axis=0)
    weight = np.log((1 + len(terms)) / (1 + found)) + 1  # rarer terms weigh more
    weight[-REPEATS:] *= 2.0
    mean = terms.mean(axis=0)
    centred = (terms - mean) * weight.astype(np.float32)
    # singular vectors of the terms through the Gram matrix
    _, axes = np.linalg.eigh((centred.T @ centred).astype(np.float64))
    axes = axes[:, ::-1][:, : min(LATENT, SIZE)].copy()
    del centred
    empty = Model(mean.astype(np.float64), weight, axes, np.zeros((0, axes.shape[1])), votes)
    vectors = np.concatenate([empty.embed(terms[lo : lo + BLOCK].astype(np.float64)) for lo in range(0, len(terms), BLOCK)])
    del terms, got
    trim()  # the driver lives on
    return Model(empty.mean, weight, axes, vectors, votes)


@lean
def _score_rows(batches, model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = np.concatenate([model.value.scores(term_counts(batch.column(1).slice(lo, BLOCK))) for lo in range(0, batch.num_rows, BLOCK)] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from THRESHOLD on): a row for each row.

    The text alone decides: equal texts score alike, and null and empty texts by the neighbours of a vector without terms.
    Ids pass through, null or repeated; other columns are not read.
    """
    arrow_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(partial(_score_rows, model=shared), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted 0, in one pass: no join, so null and repeated ids are fine."""
    arrow_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def good(batches):
        for batch in batches:
            texts = batch.column(text_col)
            scores = np.concatenate([shared.value.scores(term_counts(texts.slice(lo, BLOCK))) for lo in range(0, batch.num_rows, BLOCK)] or [np.zeros(0)])
            yield batch.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(good, docs.schema)
