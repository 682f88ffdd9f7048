import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelane.llm import bpe
from tidelane.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def check(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids, text
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_odd_texts(own, library):
    for text in ("", " ", "  a", "a  b\n\n c\t", "I'll we've 'tis'd", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "<|endoftext", "日本語 テキスト", "🎉🎉👩‍👩‍👧 é", "\x00\x1c\x1d\x85\xa0 x", "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "1234567890" * 30, "!!!???..." * 50, "ΣΑΣ ǅ ﬁ", "͸\U0001f9ff١٢٣"):
        check(own, library, text)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(own, library, text):
    check(own, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorst aei' \n", max_size=200))
def test_any_prose(own, library, text):
    check(own, library, text)


def test_tokens_side_by_side(own, library):
    rng, tokens = random.Random(3), [t for t in own.ids if len(t) > 1]
    for _ in range(3000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 4)))
        try:
            check(own, library, piece.decode())
        except UnicodeDecodeError:
            pass


def test_documents(spark, library):
    rows = [(1, None), (2, ""), (2, "again"), (None, "null id"), (3, "long word" + "x" * 100_000)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(extra).withColumn("ids", F.lit(1))
    want = []
    for doc_id, text in df.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted((tuple(r) for r in bpe.round_trip(df, PATH).collect()), key=str) == sorted(want, key=str)
    assert {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(extra, PATH), PATH).collect()} == {(d, t or "") for d, t in rows}
    assert bpe.round_trip(extra.limit(0), PATH).count() == 0
