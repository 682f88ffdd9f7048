import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_minhash import brute as near_brute
from test_packing import best_fit_decreasing

pipeline = pytest.importorskip("corpus_pipeline")

from tidelane.llm import exact_dedup, quality  # noqa: E402
from tidelane.llm.queries import tokenizer_path  # noqa: E402


def without_passages(rows, window=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, t), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_brute_force(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    rows = [(d, t) for d, t in rows if model.scores(quality.term_counts(pa.array([t])))[0] >= quality.THRESHOLD]
    last = {t: d for d, t in rows}
    rows = [(d, t) for d, t in rows if last[t] == d]
    kept = {r[0] for r in near_brute(rows, 5, 80) if r[3]}
    rows = without_passages([(d, t) for d, t in rows if d in kept])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for d, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want += [(d, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], dtype="<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    got = pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for items in placed.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(placed) <= best_fit_decreasing(Counter(r.length for r in got), 4096)


def test_tables_of_other_queries_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = exact_dedup.refine(docs, digest_all=True)
    first = pipeline.run(spark, "/root/testdata/sf0.001")
    n = first.count()
    assert before.count() == docs.count() and pipeline.run(spark, "/root/testdata/sf0.001").count() == n == first.count()


def test_stages_keep_the_columns_and_handle_odd_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-5, None, "en", None, 0), (-6, "", None, "s", None), (None, "a null id", "en", "s", 9), (-7, "word " * 30_000, "en", "s", 150_000)], docs.schema)
    for rows in (docs.union(odd), docs.limit(0)):
        n = rows.count()
        for name, apply in pipeline.STAGES[:-1]:
            out = apply(spark, rows, sf_dir)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            assert out.count() <= n
        assert pipeline.STAGES[-1][1](spark, rows, sf_dir).count() >= n
