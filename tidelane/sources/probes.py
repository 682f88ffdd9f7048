"""Probe files: JSON tables of contacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: The arrays of a probe file, by the columns that they become.
ARRAYS = {"chanMap": "ch", "xc": "x", "yc": "y", "kcoords": "shank"}


def load_probe(spark: SparkSession, path: str) -> DataFrame:
    """O-SRC-24: ch, x, y, shank, n_chan of a probe's JSON file; missing arrays (but for kcoords, then 0) and arrays of unequal length are errors."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    missing = [k for k in ("chanMap", "xc", "yc", "n_chan") if k not in found]
    if missing:
        raise ValueError(f"missing from the probe: {', '.join(missing)}")
    found.setdefault("kcoords", [0.0] * len(found["chanMap"]))
    if len({len(found[k]) for k in ARRAYS}) != 1:
        raise ValueError("a probe's arrays must have one length")
    rows = [(int(c), float(x), float(y), float(k), int(found["n_chan"])) for c, x, y, k in zip(*(found[k] for k in ARRAYS), strict=True)]
    return spark.createDataFrame(rows, "ch int, x double, y double, shank double, n_chan int")


def save_probe(contacts: DataFrame, path: str, n_chan: int | None = None) -> None:
    """O-SRC-24: contacts (ch, x, y, shank) as a probe's JSON file, in order of channels; a probe's contacts are a bounded table."""
    rows = contacts.select("ch", "x", "y", "shank").orderBy("ch").collect()
    body = {key: [r[column] for r in rows] for key, column in ARRAYS.items()} | {"n_chan": len(rows) if n_chan is None else n_chan}
    contacts.sparkSession.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
