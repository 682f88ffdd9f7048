import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidelane.llm import exact_dedup

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "a"), (None, "c"), (None, "c"), (7, "x" * 200_000), (8, "x" * 200_000), (9, "x" * 199_999 + "y"), (10, "dd"), (10, "dd"), (11, "ab"), (12, "é"), (13, "ä")]


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for d, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((d, keep, len(own), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_edge_cases(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("sha", F.lit(1)).withColumn("prefix", F.lit("p")).repartition(4)
    got = [tuple(r) for r in exact_dedup.refine(df, digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == brute(ROWS)
    lazy = [tuple(r) for r in exact_dedup.refine(df).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(lazy, key=str) == [r[:4] for r in brute(ROWS)]
    assert exact_dedup.refine(df.limit(0)).count() == 0


def test_hot_group_and_no_python(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = exact_dedup.drop_copies(df)
    assert kept.count() == 1001 and kept.columns == ["doc_id", "text"]
    plan = exact_dedup.refine(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), digest_all=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
