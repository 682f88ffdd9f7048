"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, attach_group

#: Characters of a text that the second step hashes.
PREFIX_CHARS = 128


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays. Rows are
    grouped by length, then groups by prefix hash, then what survives by the full hash; only narrow rows are exchanged.
    With digest_all the digest is a column of the result: a scan of its own gives it for every row, and only those of survivors
    take part in the grouping. Else the content is read in full for survivors only and text_sha256 is null for the others.

    Rows that repeat the kept id are marked kept too (ids are expected to be unique). A null id never stays unless all
    ids of its group are null; then all of that group's rows stay. An empty table gives an empty result. Other columns
    of docs are not read, so clashing names don't matter.
    """
    stage = Stage(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    shape = (F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix"))
    pairs = stage.write(docs.select(*shape).groupBy("n_bytes", "prefix").agg(F.count(F.lit(1)).alias("_n")), "pairs", few=True)
    lengths = pairs.groupBy("n_bytes").agg(F.sum("_n").alias("_rows")).filter("_rows > 1").select("n_bytes")
    survivors = pairs.join(lengths, "n_bytes").filter("_n > 1").select("n_bytes", "prefix")
    full = F.sha2(text.cast("binary"), 256).alias("sha")
    if digest_all:
        narrow = stage.write(docs.select(F.col(id_col).alias("doc_id"), *shape, full), "narrow", scan=True)
        hashed = narrow.join(survivors, ["n_bytes", "prefix"])
    else:
        narrow = docs.select(F.col(id_col).alias("doc_id"), *shape, F.lit(None).cast("string").alias("sha"))
        wide = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), *shape)
        hashed = wide.join(survivors.hint("merge"), ["n_bytes", "prefix"], "left_semi").select("doc_id", "n_bytes", "prefix", F.sha2(F.col("_text").cast("binary"), 256).alias("sha"))
    hashed = stage.write(hashed.select("doc_id", "n_bytes", "prefix", "sha"), "hashed", few=True)
    grouped = attach_group(
        hashed, ["n_bytes", "prefix", "sha"],
        {"_n": F.count(F.lit(1)), "_max": F.max("doc_id")}, {"group_size": F.sum("_n"), "keep_id": F.max("_max")}, ["doc_id"],
    )
    alone = narrow.join(survivors, ["n_bytes", "prefix"], "left_anti")
    return grouped.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    ).unionByName(
        alone.select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that refine() doesn't keep; ids must be unique, rows with a null id stay."""
    gone = refine(docs, id_col, text_col).filter("not kept and doc_id is not null").select(F.col("doc_id").alias(id_col))
    return docs.join(gone.hint("merge"), id_col, "left_anti")
