"""Registries of metric plug-ins and classification schemas: functions from DataFrame to DataFrame, found by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Metric = Callable[[DataFrame], DataFrame]
METRICS: dict[str, Metric] = {}
SCHEMAS: dict[str, Callable[..., DataFrame]] = {}


def metric(name: str):
    """Registers a metric: spikes -> one row a unit."""

    def add(f: Metric) -> Metric:
        METRICS[name] = f
        return f

    return add


def schema(name: str):
    """Registers a classification schema: units -> units with a class."""

    def add(f):
        SCHEMAS[name] = f
        return f

    return add


def compute(spikes: DataFrame, names: list[str] | None = None, on: str = "unit") -> DataFrame:
    """The metrics' columns side by side, by unit, from one aggregate over their union."""
    from ..operators.joins import merge_metric_tables

    unknown = [n for n in names or [] if n not in METRICS]
    if unknown:
        raise KeyError(f"unknown metrics: {', '.join(unknown)}")
    return merge_metric_tables([METRICS[n](spikes) for n in names or sorted(METRICS)], on)
