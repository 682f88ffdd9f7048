import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import media


def slow_hash(payload):
    """The cosine hash by its definition: overlap-weighted means, then sums of products of cosines."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
    h, n = len(px), media.SIDE
    small = [[0.0] * n for _ in range(n)]
    cover = lambda i, j, size: max(0.0, min((j + 1) * size / n, i + 1) - max(j * size / n, i))
    rows = [[(y, cover(y, i, h)) for y in range(int(i * h / n), min(h, math.ceil((i + 1) * h / n)))] for i in range(n)]
    for i in range(n):
        for j in range(n):
            small[i][j] = sum(wy * (px[y, 2 * j] + px[y, 2 * j + 1]) for y, wy in rows[i]) / (2 * h / n)
    unit = lambda k: math.sqrt((1 if k == 0 else 2) / n)
    low = [round(unit(u) * unit(v) * sum(small[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(n) for x in range(n)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = "".join("1" if (x > 32 * 128 if i == 0 else x > middle) else "0" for i, x in enumerate(low))
    return f"{int(bits, 2):016x}"


ROWS = [(1, None), (2, ""), (3, "x"), (4, "a" * 64), (5, "a" * 65), (6, "héllo wörld " * 50), (6, "héllo wörld " * 50), (None, "z" * 3000), (7, "long 世界 " * 40000)]


def test_round_trip_and_features(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("feature", F.lit("q"))
    got = sorted((tuple(r) for r in media.features(media.store(df)).collect()), key=str)
    want = []
    for doc_id, text in ROWS:
        raw = (text or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        png = media.encode_png(payload)
        want.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), slow_hash(payload) if len(payload) < 9000 else media.cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64))))
    assert got == sorted(want, key=str)
    assert media.features(media.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_every_row_filter_is_undone():
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (10, 64), dtype=np.uint8)
    for kinds in ([0] * 10, [2] * 10, [1, 2, 3, 4, 0] * 2):
        lines = np.zeros((10, 65), np.uint8)
        for y in range(10):
            k = lines[y, 0] = kinds[y]
            for x in range(64):
                a, b, c = int(px[y, x - 1]) if x else 0, int(px[y - 1, x]) if y else 0, int(px[y - 1, x - 1]) if x and y else 0
                p = a + b - c
                nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                lines[y, x + 1] = (int(px[y, x]) - [0, a, b, (a + b) // 2, nearest][k]) % 256
        assert (media._unfilter(lines) == px).all()


def test_rows_are_stored_in_the_form_with_fewest_bytes():
    same, rising = b"q" * 64, bytes(range(32, 96))
    noise = np.random.default_rng(2).integers(0, 256, 64 * 40000, dtype=np.uint8).tobytes()
    for payload, kinds in ((same * 3, [0, 0, 0]), (rising * 3, [1, 2, 2]), (noise[:64] * 2 + noise[64:128], [0, 2]), (noise[: 64 * 20000] * 2 + rising, None)):
        png = media.encode_png(payload)
        assert media.decode_png(png).tobytes() == payload
        lines = np.frombuffer(zlib.decompress(png[41:-16]), np.uint8).reshape(-1, 65)
        assert kinds is None or lines[: len(kinds), 0].tolist() == kinds


def test_damage_is_found():
    good = media.encode_png(b"abcd" * 64)
    assert media.decode_png(good).tobytes() == b"abcd" * 64
    for bad in (good[:-3], b"x" + good[1:], good[:50] + bytes([good[50] ^ 1]) + good[51:], good + b"x"):
        with pytest.raises(media.CorruptMedia):
            media.decode_png(bad)
