"""Structured Streaming twins of batch operators: periods, dead time, windowed rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """keys, window, n, total of a stream of events in event-time windows; events later than the watermark are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(*keys, window).agg(F.count(F.lit(1)).alias("n"))


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """keys, session (window), n: sessions close after a pause of `gap`. Unlike periods, a pause of exactly the gap closes one."""
    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"))


def dead_time(events: DataFrame, key: str, t: str, dead: int) -> DataFrame:
    """O-WIN-14/15 as a stream: key, t of events kept greedily, the last kept one carried as state (one number a key).

    Within a micro-batch a key's events are put in order; an event earlier than the last kept one plus the dead time is
    dropped, so streams must arrive in order by key across batches.
    """

    def keep(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for x in sorted(x for frame in frames for x in frame[t].tolist()):
            if last is None or x >= last + dead:
                kept.append(x)
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), t: pd.Series(kept, dtype="int64")})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, t).groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, {t} long", "last long", "append", GroupStateTimeout.NoTimeout)


def last_values(events: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """The latest values of each key so far (update or complete mode): one row of state a key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), time).alias("last"), F.max(time).alias(time))
