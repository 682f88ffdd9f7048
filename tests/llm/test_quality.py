import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidelane.llm import arrowtext as at
from tidelane.llm import quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels))
    rows = scored.join(labels.filter("quality is not null").select("doc_id", "quality"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    test = [r for r in rows if r.held_out]
    good, bad = [[r.predicted == q for r in test if r.quality == q] for q in (1, 0)]
    print(len(good), len(bad), np.mean(good), np.mean(bad))
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.9


def test_only_the_text_counts_and_edges(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.union(labels).union(spark.createDataFrame([(None, 1, 0), (-7, None, None), (-8, 1, 0)], labels.schema)))
    rows = [(1, None), (2, ""), (None, "x"), (4, "a b " * 50_000), (4, "a b " * 50_000), (5, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(1))
    got = quality.score(df, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score and got[3].score == got[4].score
    assert quality.score(df.limit(0), model).count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(df, nothing).collect()} == {0.5}


def by_hand(model, terms):
    """Each text by itself: all similarities, the nearest by similarity to 6 digits and then in order, weighted votes."""
    out = []
    for t in terms.astype(np.float64):
        v = ((t - model.mean) * model.weight) @ model.axes
        v = v / max(np.linalg.norm(v), 1e-9)
        similar = [round(float(v @ u), 6) for u in model.vectors]
        near = sorted(range(len(similar)), key=lambda i: (-similar[i], i))[: quality.NEIGHBOURS]
        w = [max(similar[i], 0.0) ** quality.SHARPNESS for i in near]
        votes = [model.labels[i] for i in near]
        out.append(sum(x * y for x, y in zip(w, votes)) / sum(w) if sum(w) > 0 else float(np.mean(votes)))
    return out


def small_model(rng, n=60, ties=False):
    vectors = rng.normal(size=(n, 4))
    if ties:
        vectors = np.repeat(vectors[: n // 6], 6, axis=0)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return quality.Model(np.zeros(4), np.ones(4), np.eye(4), vectors, rng.integers(0, 2, n).astype(float))


def test_blocked_products_equal_one_text_at_a_time():
    rng = np.random.default_rng(0)
    model, x = small_model(rng), rng.normal(size=(1300, 4)).astype(np.float32)
    got = model.scores(x)
    assert np.allclose(got[::97], by_hand(model, x[::97]), atol=1e-5)
    assert (got == np.concatenate([model.scores(x[i : i + 7]) for i in range(0, 1300, 7)])).all()


def test_ties_go_to_the_first_vectors():
    rng = np.random.default_rng(1)
    model, x = small_model(rng, 120, True), rng.normal(size=(40, 4)).astype(np.float32)
    got = model.scores(x)
    assert np.allclose(got, by_hand(model, x), atol=1e-5)
    assert (got == np.array([model.scores(x[i : i + 1])[0] for i in range(40)])).all()
    few = quality.Model(model.mean, model.weight, model.axes, model.vectors[:3], model.labels[:3])
    assert np.allclose(few.scores(x), by_hand(few, x), atol=1e-5)


def test_fit_against_a_dense_decomposition(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    known = {r.doc_id: r.quality for r in labels.filter("quality is not null").orderBy("quality").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    terms = quality.term_counts(pa.array([t for _, t in rows])).astype(np.float64)
    assert model.labels.tolist() == [known[d] for d, _ in rows] and np.allclose(model.mean, terms.mean(0), atol=1e-6)
    assert np.allclose(model.weight[:-quality.REPEATS], np.log((1 + len(terms)) / (1 + (terms > 0).sum(0)))[:-quality.REPEATS] + 1)
    _, s, v = np.linalg.svd((terms - terms.mean(0)) * model.weight, full_matrices=False)
    k = quality.LATENT // 2
    assert np.allclose(model.axes[:, :k] @ model.axes[:, :k].T, v[:k].T @ v[:k], atol=1e-3) or np.min(np.diff(-s[: k + 1])) < 1e-3 * s[0]
    embedded = ((terms - model.mean) * model.weight) @ model.axes
    assert np.allclose(model.vectors, embedded / np.linalg.norm(embedded, axis=1, keepdims=True), atol=1e-5)


def test_repeated_ids_are_one_text_each(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    once = quality.fit(docs, labels)
    thrice = quality.fit(docs.union(docs).union(docs.withColumn("text", F.concat(F.lit("\U0010ffff"), "text"))), labels)
    assert thrice.labels.tolist() == once.labels.tolist() and np.allclose(thrice.vectors, once.vectors)


def test_terms_by_counting():
    text = "The cat; the  CAT sat\non the mat mat"
    got = quality.term_counts(pa.array([text]))[0]
    places = [int(at.word_hashes(w)[0] >> np.uint64(64 - 10)) for x in text.split() for w in at.words(pa.array([x]), lower=True)]
    want = np.zeros(quality.WORDS)
    for p in places:
        want[p] += 1
    assert np.allclose(got[: quality.WORDS], np.sqrt(want / len(places)), atol=1e-6)
    assert np.isclose((got[quality.WORDS : quality.WORDS + quality.SHAPES] ** 2).sum(), 1)
    assert np.isclose(got[-quality.REPEATS], np.sqrt(1 / len(places)))  # only "mat mat" repeats at distance 1


def test_terms_of_each_text_alone():
    texts = ["one two two", "", None, "Zwei  Äpfel!! 12"]
    together = quality.term_counts(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], quality.term_counts(pa.array([t], pa.string()))[0])
