"""Counters of a run (A10): what was skipped, dropped or written, counted while the rows pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """The rows unchanged, and an observation: `rows` and how many rows meet each condition. Its `get` has the counts
    once an action has run; no pass of its own is made."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(k) for k, c in conditions.items()]), seen
