"""The corpus pipeline: quality filter, exact dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. run() writes each stage's result as Parquet and reads it again as the next one's docs.
As results are written before the next stage begins, a stage first deletes the tables that the pipeline's earlier ones left in
the shared folder; tables of other queries stay.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import exact_dedup, minhash, packing, quality, substring_dedup
from tidelane.llm.common import Stage, noted
from tidelane.llm.queries import tokenizer_path


#: Stages of tables that the last pipeline stage made.
_MADE: list[Stage] = []


def _alone(apply):
    """A pipeline stage that first closes what the one before it made: that result has been written by then."""

    @functools.wraps(apply)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _MADE:
            _MADE.pop().close()
        with noted(_MADE):
            return apply(spark, docs, sf_dir)

    return run


@_alone
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier, fitted on the labels that aren't held out, scores 0.7 or more."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_alone
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id. A repeated id stands for all its texts: if one of them is a copy, all its rows go."""
    return exact_dedup.drop_copies(docs)


@_alone
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id: five-word shingles, similarity 0.8 or more, as stages take them where no contract names other ones.

    A repeated id stands for all its texts: if one of them is a copy, all its rows go, those of the id that stays all stay.
    """
    gone = minhash.link(docs).filter("not kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


@_alone
def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows of 35 words, as their kept words joined by one space; untouched texts as they are, and n_chars of what is left.

    A text without words left stays as an empty one.
    """
    others = tuple(c for c in docs.columns if c != "text")
    kept = substring_dedup.remove_repeats(docs.withColumn("_no_text", F.col("text").isNull()), with_text=True, carry=(*others, "_no_text"))
    new = {"text": F.when(~F.col("carry._no_text"), F.col("kept_text")), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("carry.n_chars"))}
    return kept.select(*[new.get(c, F.col(f"carry.`{c}`")).alias(c) for c in docs.columns])


@_alone
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact),
    ("MinHash near-dedup", drop_near),
    ("substring dedup", drop_passages),
    ("best-fit packing", pack_sequences),
]

#: MinHash, the classifier and packing have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Their table stays until the driver's Python ends, those of earlier stages go once they are read."""
    stage = Stage(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, apply) in enumerate(STAGES):
        docs = stage.write(apply(spark, docs, sf_dir), f"stage{k}")
        if k:
            stage.drop(f"stage{k - 1}")
    while _MADE:
        _MADE.pop().close()
    return docs
