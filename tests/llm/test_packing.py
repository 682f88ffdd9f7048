import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import packing
from tidelane.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def bins_of(counts, capacity):
    """Every bin's items, from the plan's runs; tests that ranks are used once each and items don't overlap."""
    runs, bins = packing.plan(dict(counts), capacity), defaultdict(list)
    for size in counts:
        own = runs[runs[:, 0] == size]
        ends = np.append(own[1:, 1], counts[size])
        assert counts[size] == 0 or own[0, 1] == 0
        for (_, rank, each, first, offset), end in zip(own.tolist(), ends.tolist()):
            for i in range(end - rank):
                bins[first + i // each].append((offset + i % each * size, size))
    for items in bins.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity
    assert sum(map(len, bins.values())) == sum(counts.values())
    assert sorted(bins) == list(range(len(bins)))
    return bins


def best_fit_decreasing(counts, capacity):
    room, n = Counter(), 0
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            gap = min((g for g in room if g >= size and room[g]), default=0)
            if gap:
                room[gap] -= 1
            else:
                gap, n = capacity, n + 1
            room[gap - size] += 1
    return n


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 96, 100])
    counts = Counter(rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 3)), capacity]) for _ in range(rng.choice([0, 1, 5, 60, 900])))
    bins = bins_of(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    assert len(bins) >= -(-total // capacity)
    assert len(bins) <= max(best_fit_decreasing(counts, capacity) * 1.02 + 1, -(-total // capacity))
    assert all(sum(3 * s > capacity for _, s in items) <= 2 for items in bins.values())


def test_plan_is_bounded_by_the_capacity():
    rng = random.Random(1)
    few, many = ({s: rng.randint(1, top) for s in range(1, 4097)} for top in (20, 10**9))
    assert len(packing.plan(many)) < 8 * 4096 and len(packing.plan(few)) < 8 * 4096


def test_documents(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = [(-1, None), (-2, ""), (None, "x"), (-3, "Ünïcödé ΣΑΣ <|endoftext|> it's 12"), (-3, "same id"), (-4, "a b " * 5000), (-5, "日本 \x1c x\xa0y")]
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = packing.pack_documents(df.withColumn("offset", F.lit(1)), PATH).collect()
    want = []
    for doc_id, text in df.collect():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], dtype="<u4")
            want.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for items in placed.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(placed) <= best_fit_decreasing(Counter(r.length for r in got), 4096) and len(placed) <= 1.02 * total / 4096 + 2
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
