"""Registration of queries over the driver's tables, and the roles that those tables play.

events are spikes or pulses (user_id the unit, ts the time in microseconds, event_type the channel, value the amplitude);
orders and lineitem are epochs and their samples; supplier, nation, region are channels, shanks, probes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import micros, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR

#: What spikes() gives, as a common table expression.
SPIKES_SQL = "spikes AS (SELECT user_id AS unit, epoch_us(ts) AS t, event_type AS ch, value AS v, event_id AS id FROM events)"


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL where SQL can say it; {spikes} stands for SPIKES_SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{spikes}", SPIKES_SQL)
        return f

    return add


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, t (microseconds), ch, v, id."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), micros("ts").alias("t"), F.col("event_type").alias("ch"), F.col("value").alias("v"), F.col("event_id").alias("id"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ch (0-based), shank, probe, x, y, connected: suppliers as the contacts of a probe."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("ch"), F.col("s_nationkey").alias("shank"), F.col("n_regionkey").alias("probe"),
        (F.col("s_suppkey") % 4 * 20.0).alias("x"), (F.floor(F.col("s_suppkey") / 4) * 15.0).alias("y"), (F.col("s_acctbal") >= 0).alias("connected"),
    )


#: What channels() gives, as a common table expression.
CHANNELS_SQL = """channels AS (SELECT s_suppkey AS ch, s_nationkey AS shank, n_regionkey AS probe, s_suppkey % 4 * 20.0 AS x,
    floor(s_suppkey / 4) * 15.0 AS y, s_acctbal >= 0 AS connected FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
