import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import minhash
from tidelane.llm.common import Stage
from tidelane.llm.components import components

BLANKS = re.compile("[^\x20\x09-\x0d]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows, shingle, percent):
    """Every pair that shares a shingle, by an inverted index; union-find by least id."""
    sets = []
    for _, t in rows:
        w = BLANKS.findall(lowered(t))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if rows[i][0] is not None and rows[j][0] is not None and 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least[find(i)] if d is not None else None, d == least[find(i)] if d is not None else True) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def family(seed, n, base_words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
        out.append(" ".join(t))
    return out


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d"), (7, "a b c d"), (8, "a"), (9, "é É"), (10, "É é"), (None, "a b c d"), (12, "z " * 9000), (13, "Z " * 4000), (14, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(7)).withColumn("bands", F.lit("q"))
    assert got(minhash.link(df, shingle=4)) == brute(rows, 4, 80)
    assert got(minhash.link(df)) == brute(rows, 5, 80)
    assert got(minhash.link(df.limit(0))) == []


def test_families_and_chains(spark):
    texts = [t for s in range(12) for t in family(s, 25, 30 + 7 * s)]
    chain = [f"c{i}" for i in range(40)]
    texts += [" ".join(chain[k : k + 30] + [f"d{j}" for j in range(k)]) for k in range(8)]
    random.Random(5).shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    assert got(minhash.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shingle=4)) == brute(rows, 4, 80)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(minhash.link(df.repartition(4), shingle=4)) == brute(rows, 4, 80)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(7, 9), (9, 8), (8, 7), (3, 3)]
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 600)} | {7: 7, 8: 7, 9: 7}
    for tasks in (1, 7):
        df = spark.createDataFrame(edges, "u long, v long").repartition(tasks)
        assert {r.node: r.component for r in components(df, Stage(spark)).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long"), Stage(spark)).count() == 0


@pytest.mark.parametrize("part", [7, 4096])
def test_search_of_what_stars_leave(spark, monkeypatch, part):
    """One bucket for all texts, none of them linked yet: the search alone must find every component."""
    monkeypatch.setattr(minhash, "LIST_PART", part)
    texts = family(3, 120, 40) + family(4, 60, 200)
    rows = [(i, " ".join(t.split()[: len(t.split()) - i % 9])) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands = docs.select("doc_id", F.col("doc_id").alias("part"), F.unhex(F.lit("07" * 8)).alias("bands"))
    want = {r[0]: r[2] for r in brute(rows, 3, 80)}
    stage = Stage(spark)
    pairs = {(r.x, r.hub) for r in minhash.leftovers(bands, docs, stage, 3, 80).collect()}
    sets = [set(zip(*[t.split()[k:] for k in range(3)])) for _, t in rows]
    links = {(x, y) for x in range(len(rows)) for y in range(x) if len(sets[x] & sets[y]) * 100 >= 80 * len(sets[x] | sets[y])}
    assert links <= pairs and len(want) == len(rows)


def near_copies(n, words):
    """n copies of one text of that many words with up to three words changed: most pairs are not similar enough."""
    return list(dict.fromkeys(family(11, n, words)))


def by_matrix(texts, shingle, percent):
    """Components of all pairs, by one product of the incidence matrix."""
    number = {}
    sets = [{number.setdefault(x, len(number)) for x in zip(*[t.split()[k:] for k in range(shingle)])} for t in texts]
    m = np.zeros((len(sets), len(number)), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, list(s)] = 1
    common, size = m @ m.T, np.array([len(s) for s in sets])
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    label = np.arange(len(sets))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            return label.tolist()
        label = new


def test_large_family_under_two_layouts(spark):
    texts = near_copies(4300, 50)
    assert len(texts) > 3000
    want = by_matrix(texts, 4, 80)
    assert len(set(want)) > 100  # the family isn't one component
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for layout in (docs.coalesce(1), docs.repartition(9, "text")):
        assert {r.doc_id: r.component_id for r in minhash.link(layout, shingle=4).collect()} == dict(enumerate(want))


def test_repeated_id_stands_for_all_its_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (9, a + " more"), (7, b + " more"), (8, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.link(docs, shingle=4).collect()) == [(5, 5), (5, 5), (7, 5), (8, 8), (9, 5)]


def test_words_that_collide_modulo_two_to_the_64(spark):
    """A word of 4096 letters over {a, b} and its opposite (Thue-Morse) have equal polynomial hashes modulo 2**64 under any odd base."""
    word = "a"
    for _ in range(12):
        word += word.translate({97: 98, 98: 97})
    opposite = word.translate({97: 98, 98: 97})
    rows = [(1, word), (2, opposite), (3, f"one two three {word} five six"), (4, f"one two three {opposite} five six")]
    assert got(minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)) == brute(rows, 4, 80)
