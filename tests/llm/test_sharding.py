import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidelane.llm import sharding


def verify(rows, got, shards=40):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    sizes = [sum(r.size for r in by[s]) for s in range(shards)]
    return sizes, total / shards, largest


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    sizes, mean, largest = verify(rows, sharding.shard(df).collect())
    assert max(sizes) - min(sizes) <= 2 * largest


def test_hot_group_is_cut_only_where_needed(spark):
    rows = [(i, "hot text " * 5) for i in range(4000)] + [(10_000 + i, f"text {i % 5000} " * 3) for i in range(8000)] + [(None, None), (5, None), (5, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).repartition(5)
    got = sharding.shard(df).collect()
    sizes, mean, largest = verify(rows, got)
    assert max(sizes) <= 1.02 * mean + largest and min(sizes) >= 0.98 * mean - largest
    places = defaultdict(set)
    for r in got:
        places[r.text_crc32].add(r.shard)
    assert len(places[zlib.crc32(("hot text " * 5).encode())]) >= 10
    assert sum(len(p) > 1 for p in places.values()) <= 3


def test_a_hot_text_gets_its_share_of_parts(spark):
    rows = [(i, "hot text") for i in range(6000)] + [(10_000 + i, f"text {i}") for i in range(6000)]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("shiftleft(shiftrightunsigned(xxhash64(7, text), 33), 32) + shiftrightunsigned(xxhash64(11, doc_id, text), 32) AS key", "24L AS size")
    cuts = sharding.splitters(keyed, 3)
    bounds, n = sharding.part_bounds(keyed, cuts)
    assert n.sum() == 12_000 and n.max() <= 2 * 12_000 // 3 // sharding.PARTS and set(cuts.tolist()) <= set(bounds.tolist())
    same = keyed.limit(1).crossJoin(spark.range(500)).select("key", "size")
    bounds, n = sharding.part_bounds(same, np.zeros(0, dtype=np.int64))
    assert n.max() == n.sum() == 500


def test_few_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (3, "long " * 400_000), (4, "é")]
    verify(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
