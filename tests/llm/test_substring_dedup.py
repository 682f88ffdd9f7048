import hashlib
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelane.llm import substring_dedup
from tidelane.llm.common import Stage


def brute(rows, window):
    """n_words, n_removed and kept digest of each text by counting every window's words."""
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc_id, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def passage(n, seed):
    return " ".join(f"w{(i * i * 7 + seed * 1013) % 997}" for i in range(n))


EDGE = [
    (1, None), (2, ""), (3, "  \t\n "), (4, passage(34, 1)), (5, passage(34, 1)), (6, passage(35, 2)), (7, "pre " + passage(35, 2) + " post"),
    (8, passage(35, 2)), (None, passage(60, 3)), (10, "x " + passage(60, 3)), (11, "a " * 36), (12, "b " * 35), (13, passage(500, 4)), (13, passage(500, 4)),
    (14, passage(40, 5) + " y " + passage(40, 5)), (15, "café x y " + passage(50, 6)), (16, passage(50, 6) + "\x0b\x0cz"), (17, passage(30000, 7)),
]


def test_edge_cases_against_brute_force(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("places", F.lit(1)).withColumn("key", F.lit("x")).repartition(3)
    assert got(substring_dedup.remove_repeats(df)) == brute(EDGE, 35)


def test_texts_are_rebuilt(spark):
    df = spark.createDataFrame(EDGE[:8], "doc_id long, text string")
    texts = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(df, with_text=True).collect()}
    assert texts[7] == "pre post" and texts[6] == "" and texts[4] == EDGE[3][1] and texts[1] == ""


def test_empty_table(spark):
    assert got(substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_against_brute_force(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(substring_dedup.remove_repeats(df.repartition(5))) == brute(rows, 35)


def test_history_of_earlier_batches(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    parts = [spark.createDataFrame(rows[i::3], "doc_id long, text string") for i in range(3)]
    stage = Stage(spark)
    history = stage.write(substring_dedup.fingerprint_history(parts[0]), "h0")
    history = stage.write(substring_dedup.fingerprint_history(parts[1], history=history), "h1")
    assert history.filter("level = 2").count() == history.filter("level = 2").select("bucket").distinct().count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")  # the history brings its own number of buckets
    try:
        found = got(substring_dedup.remove_repeats(parts[2], history=history))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    mixed = history.unionByName(history.withColumn("buckets", F.lit(5).cast("long")))
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(parts[2], history=mixed)
    last = {r[0] for r in rows[2::3]}
    assert found == [r for r in brute(rows, 35) if r[0] in last]


def test_words_that_collide_modulo_two_to_the_64(spark):
    """Thue-Morse: two words that every polynomial hash modulo 2**64 takes for one. A window with either isn't a repeat."""
    word = "a"
    for _ in range(12):
        word += word.translate({97: 98, 98: 97})
    opposite = word.translate({97: 98, 98: 97})
    rest = [passage(17, 8), passage(17, 9)]
    rows = [(1, f"{rest[0]} {word} {rest[1]}"), (2, f"{rest[0]} {opposite} {rest[1]}"), (3, f"{rest[0]} {opposite} {rest[1]}")]
    found = got(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == brute(rows, 35) and [r[2] for r in found] == [0, 35, 35]


def test_arrow_functions_in_a_new_process():
    """Each Python worker must manage with this module's own imports."""
    code = """
import pyarrow as pa
from tidelane.llm import substring_dedup as sd
texts = pa.array(["w " * 50, "v " * 40, None])
keys = pa.array([b"k" * 16, b"l" * 16, b"m" * 16])
sd._block = lambda: 0
runs = pa.Table.from_batches(list(sd._anchor_run(iter([pa.RecordBatch.from_arrays([keys, texts], ["key", "text"])]), 35, 10, 4)))
found = runs.filter(sd.pc.greater_equal(runs["bucket"], 0)).select(["block", "bucket", "prints", "checks", "many"])
for b in found["bucket"].unique().to_pylist():
    part = found.filter(sd.pc.equal(found["bucket"], b))
    assert sd._merge_masks(part).num_rows and sd._merge_history(part).num_rows
batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), keys, texts, pa.array([bytes(4), None, None], pa.binary()), pa.nulls(3, pa.string())], ["doc_id", "key", "text", "places", "carry"])
rows = pa.Table.from_batches(list(sd._open_or_done(iter([batch]), 35, 10, 4, pa.string(), False)))
assert rows["kind"].to_pylist().count("done") == 2
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])
