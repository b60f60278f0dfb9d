"""The latest version of every key of a change log.

Versions are ordered by seq alone. An aggregation with partial sums is the default form: versions of a hot key
collapse in each task before the shuffle. Filters on key pass below it to the scan; the filter on op must stay
above it, for a deletion has to win first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE, PUT


def latest(log: DataFrame, *by: str) -> DataFrame:
    """(by, seq, op, key, value): the newest change of each key, deletions among them. The struct keeps a null value."""
    newest = F.max(F.struct("seq", "op", "value")).alias("n")
    return log.groupBy(*by, "key").agg(newest).select(*by, "n.seq", "n.op", "key", "n.value")


def latest_by_window(log: DataFrame) -> DataFrame:
    """latest() by a ranking window, which Spark plans with partial group limits."""
    w = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return log.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").select("seq", "op", "key", "value")


def current(log: DataFrame) -> DataFrame:
    """(key, value, seq) of all live keys."""
    return latest(log).where(F.col("op") == PUT).select("key", "value", "seq")


def tombstones(log: DataFrame) -> DataFrame:
    """(key, seq) of keys whose newest change is a deletion."""
    return latest(log).where(F.col("op") == DELETE).select("key", "seq")


def merge_runs(runs: list[DataFrame], drop_tombstones: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a key of several runs, the newest, for each value of by; deletions go only where no older run can hold the key."""
    first, *rest = runs
    for other in rest:
        first = first.unionByName(other)
    merged = latest(first.select(*by, "seq", "op", "key", "value"), *by)
    return merged.where(F.col("op") == PUT) if drop_tombstones else merged
