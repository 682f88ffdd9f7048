"""Sinks: ordered binary export, tables, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_frames(samples: DataFrame, path: str, chunk: int) -> None:
    """O-SNK-01: samples (ch, s, v) as a Parquet table of chunks: chunk, first, n, data (interleaved 16-bit numbers).

    A chunk is complete: channels times samples; a chunk is one row, so its size bounds the memory of a task.
    """
    import numpy as np
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.sort_values(["s", "ch"])
        n = wide["s"].nunique()
        if len(wide) != n * wide["ch"].nunique():
            raise ValueError("a chunk lacks samples")
        return pd.DataFrame({"chunk": [int(wide["_c"].iloc[0])], "first": [int(wide["s"].min())], "n": [n], "data": [np.rint(wide["v"].to_numpy()).astype("<i2").tobytes()]})

    rows = samples.withColumn("_c", F.floor(F.col("s") / chunk))
    rows.groupBy("_c").applyInPandas(pack, "chunk long, first long, n int, data binary").write.parquet(path)


def validate_size(frames: DataFrame, n_channels: int, expected: int, tolerance: int = 0, itemsize: int = 2) -> bool:
    """O-SNK-02: whether stored chunks hold the expected number of frames within a tolerance; a ragged chunk is an error."""
    row = frames.agg(F.sum(F.octet_length("data")).alias("b"), F.max(F.octet_length("data") % (n_channels * itemsize)).alias("r")).first()
    if row.r:
        raise ValueError("a chunk holds part of a frame")
    return abs((row.b or 0) // (n_channels * itemsize) - expected) <= tolerance


def write_tsv(df: DataFrame, path: str, drop: tuple[str, ...] = ("firing_rate",)) -> None:
    """O-SNK-10: a tab-separated table with header, without the columns of `drop`."""
    df.drop(*drop).write.csv(path, sep="\t", header=True)


def manifest(partitions: DataFrame, mode: str, version: int = 1) -> str:
    """O-SNK-06: JSON of partitions (name, channels, ...); partitions are a bounded table."""
    rows = [json.loads(r[0]) for r in partitions.select(F.to_json(F.struct("*"))).collect()]
    return json.dumps({"schema_version": version, "mode": mode, "partitions": sorted(rows, key=lambda r: r["name"])}, indent=2)
