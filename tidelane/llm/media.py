"""Media columns: lossless 8-bit greyscale PNG in binary columns, read back with checksum tests, and low-frequency cosine hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_limits, lean

#: Bytes of a row of the image; payloads are padded with zeros to a positive multiple of it.
WIDTH = 64
#: The image is averaged down to SIDE x SIDE; its LOW x LOW lowest frequencies are hashed.
SIDE, LOW = 32, 8
#: Rows of pixels that averaging takes at once, which bounds the memory of a very long text.
BLOCK_ROWS = 1 << 14

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


class CorruptMedia(ValueError):
    """The stored form fails a test of its structure or checksums."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _distinct(rows: np.ndarray) -> np.ndarray:
    """How many different bytes each row holds."""
    ordered = np.sort(rows, axis=1)
    return 1 + (ordered[:, 1:] != ordered[:, :-1]).sum(axis=1)


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """payload, a positive multiple of width bytes, as a greyscale PNG.

    Each row is stored as it is, less its left neighbours, or less the row above: whichever holds the fewest different
    bytes, of equal ones the first. Text mostly stays as it is; runs of one letter and repeated rows don't.
    """
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    lines = np.empty((len(rows), width + 1), dtype=np.uint8)
    for lo in range(0, len(rows), BLOCK_ROWS):
        part = rows[lo : lo + BLOCK_ROWS]
        left, up = part.copy(), part.copy()
        left[:, 1:] -= part[:, :-1]
        up[1:] -= part[:-1]
        if lo:
            up[0] -= rows[lo - 1]
        forms = (part, left, up)
        kind = np.argmin(np.stack([_distinct(x) for x in forms]), axis=0)
        lines[lo : lo + len(part), 0] = kind
        for k, form in enumerate(forms):
            lines[lo : lo + len(part), 1:][kind == k] = form[kind == k]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _summed(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Pixels of rows of filters 0 to 2: running sums along rows, then down each run of rows of filter 2."""
    left = kinds == 1
    rows[left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
    up = kinds == 2
    if not up.any():
        return rows
    total = np.concatenate([np.zeros((1, rows.shape[1]), dtype=np.uint8), np.cumsum(rows, axis=0, dtype=np.uint8)])
    first = np.maximum.accumulate(np.where(up, -1, np.arange(len(rows))))  # the row that a run stands on, -1 for `above`
    return total[1:] - total[np.maximum(first, 0)] + np.where(first[:, None] < 0, above, np.uint8(0))


def _swept(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Pixels of rows of any filter: all pixels of an antidiagonal at once, as each needs only its left, upper and corner neighbours."""
    n, width = rows.shape
    out = np.zeros((n + 1, width + 1), dtype=np.int16)
    out[0, 1:] = above
    for d in range(n + width - 1):
        y = np.arange(max(0, d - width + 1), min(n, d + 1))
        x = d - y
        left, up, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y]
        near = left + up - corner
        to_left, to_up, to_corner = abs(near - left), abs(near - up), abs(near - corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        out[y + 1, x + 1] = (rows[y, x] + np.choose(kind, [np.zeros_like(left), left, up, (left + up) >> 1, paeth])) & 255
    return out[1:, 1:].astype(np.uint8)


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Pixels of rows that begin with their filter's number: 0 none, 1 left, 2 up, 3 average, 4 Paeth."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise CorruptMedia("unknown row filter")
    if not kinds.any():
        return rows
    hard = np.flatnonzero(kinds > 2)
    lo, hi = (hard[0], hard[-1] + 1) if len(hard) else (len(rows), len(rows))
    above = np.zeros(rows.shape[1], dtype=np.uint8)
    parts = []
    for part, undo in ((slice(0, lo), _summed), (slice(lo, hi), _swept), (slice(hi, len(rows)), _summed)):
        if part.start < part.stop:
            parts.append(undo(kinds[part], rows[part], above))
            above = parts[-1][-1]
    return np.concatenate(parts)


def decode_png(media: bytes) -> np.ndarray:
    """Pixels of an 8-bit greyscale PNG without interlacing; raises CorruptMedia if any test fails."""
    if media[:8] != _SIGNATURE:
        raise CorruptMedia("no PNG signature")
    at, parts, head, ended = 8, [], None, False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise CorruptMedia("a chunk is cut off")
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media) or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise CorruptMedia("a chunk fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0) or not ended or at != len(media):
        raise CorruptMedia("not one whole 8-bit greyscale image")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise CorruptMedia("the pixel stream is damaged") from e
    if len(raw) != head[1] * (head[0] + 1):
        raise CorruptMedia("the pixel stream has another size than the header says")
    return _unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(head[1], head[0] + 1))


@cache
def _cosines() -> np.ndarray:
    """The LOW lowest rows of the orthonormal cosine transform of SIDE points."""
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    table = np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE)) * np.sqrt(2 / SIDE)
    table[0] /= np.sqrt(2)
    return table


def _shares(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of SIDE equal parts of n points, in points."""
    edges = np.arange(SIDE + 1) * (n / SIDE)
    return edges[:-1], edges[1:]


def _averaged(pixels: np.ndarray) -> np.ndarray:
    """pixels averaged over SIDE x SIDE equal areas, sums of whole rows taken blockwise."""
    columns = np.zeros((pixels.shape[1] + 1, SIDE))
    for j, (a, b) in enumerate(zip(*_shares(pixels.shape[1]), strict=True)):
        for x in range(int(a), min(int(np.ceil(b)), pixels.shape[1])):
            columns[x, j] = min(b, x + 1) - max(a, x)
    columns = columns[:-1] / columns[:-1].sum(axis=0)
    h = len(pixels)
    out = np.zeros((SIDE, SIDE))
    for lo in range(0, h, BLOCK_ROWS):
        narrow = pixels[lo : lo + BLOCK_ROWS].astype(np.float64) @ columns
        rows = np.arange(lo, lo + len(narrow))
        for i, (a, b) in enumerate(zip(*_shares(h), strict=True)):
            first, last = max(int(a), lo), min(int(np.ceil(b)), lo + len(narrow))
            if first < last:
                at = rows[first - lo : last - lo]
                weight = np.minimum(b, at + 1) - np.maximum(a, at)
                out[i] += weight @ narrow[first - lo : last - lo]
    return out / (h / SIDE)


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the LOW x LOW lowest frequencies exceed the median of those without the mean.

    Coefficients are rounded to 6 digits first, so that rounding errors don't decide a bit.
    """
    low = np.round(_cosines() @ _averaged(pixels) @ _cosines().T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = low[0] > SIDE * 128
    return np.packbits(bits).tobytes().hex()


MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


@lean
def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media, sizes = [], []
        for text in batch.column(1):
            raw = (text.as_py() or "").encode()
            sizes.append(len(raw))
            media.append(encode_png(raw + bytes((-len(raw)) % WIDTH or (0 if raw else WIDTH))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a PNG.

    A null text is empty; ids pass through, null or repeated; other columns are not read.
    """
    arrow_limits(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


@lean
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, media in zip(*(batch.column(i) for i in range(3)), strict=True):
            media = media.as_py()
            pixels = decode_png(media)
            payload = pixels.tobytes()
            rows.append((doc_id.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(pixels)))
        names = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in MEDIA_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: sizes, digests and the hash. A damaged value fails the job with CorruptMedia."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, MEDIA_SCHEMA)
