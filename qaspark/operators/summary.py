"""Counts over stage tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """One row per stage: ``(stage, n)``. Each count is a global aggregate combined in the map tasks.

    For stages that a flow has ``written`` no text is read and nothing is computed again. Counters inside the running flow would
    need no second look, but a stage that is repeated after a lost executor counts twice there.
    """
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    return reduce(DataFrame.unionByName, counts)
