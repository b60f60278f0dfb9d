"""Lookups and scans. Batched forms are the primary ones: one job serves any number of keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PUT
from .ranks import bounds, ranges, slot_of
from .resolve import current, latest


def get(log: DataFrame, key) -> DataFrame:
    """(key, value, seq) of one key, or no row."""
    return current(log.where(F.col("key") == F.lit(key)))


#: Probes up to this many keys are sent to all tasks that read the log.
FEW_KEYS = 50_000


def multi_get(log: DataFrame, probes: DataFrame, few_keys: int = FEW_KEYS, resolve: Callable[[DataFrame], DataFrame] = current) -> DataFrame:
    """(key, value, status) for every row of probes (key); status is OK or NotFound.

    Probed keys are counted up to few_keys first. If they are few, a broadcast semi join keeps all else out of the
    resolve. Otherwise the log is resolved with partial sums, which fold a hot key's versions in each task,
    and joined on the key that it is then already partitioned by.
    """
    wanted = probes.select("key").distinct()
    if wanted.limit(few_keys + 1).count() <= few_keys:
        log = log.join(F.broadcast(wanted), "key", "left_semi")
    live = resolve(log).select("key", "value", F.lit("OK").alias("status"))
    return probes.select("key").join(live, "key", "left").withColumn("status", F.coalesce("status", F.lit("NotFound")))


def scan(log: DataFrame, start, end, resolve: Callable[[DataFrame], DataFrame] = current) -> DataFrame:
    """(key, value) of live keys in [start, end), in key order; empty if start >= end. resolve gives the live rows of log."""
    return scan_unordered(log, start, end, resolve).orderBy("key")


def scan_unordered(log: DataFrame, start, end, resolve: Callable[[DataFrame], DataFrame] = current) -> DataFrame:
    return resolve(log.where((F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end)))).select("key", "value")


def seek(log: DataFrame, target) -> DataFrame:
    """(key, value) of the first live key at or after target."""
    return current(log.where(F.col("key") >= F.lit(target))).select("key", "value").orderBy("key").limit(1)


def multi_seek(log: DataFrame, probes: DataFrame, slots: int | None = None) -> DataFrame:
    """(target, key) for every row of probes (target): its first live key at or after, or null.

    A merge by ranges, not a join of all pairs: live keys and targets are split at the same bounds, which are sampled
    once. In a range the next key is a window's minimum over the rows from there on; a target past its range's last key
    takes the first key of the next range that has one, from a table of a row a range. A null target has none.
    """
    live = current(log).select("key")
    kind = live.schema["key"].dataType
    cuts = bounds(log.select("key").unionByName(probes.select(F.col("target").alias("key"))), slots or ranges(log))
    rows = live.select("key", F.lit(None).cast(kind).alias("target"), F.lit(False).alias("asked"), F.col("key").alias("at"))
    asked = probes.select(F.lit(None).cast(kind).alias("key"), "target", F.lit(True).alias("asked"), F.col("target").alias("at"))
    here = Window.partitionBy("slot").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.unionByName(asked).withColumn("slot", slot_of("at", cuts)).withColumn("next", F.min("key").over(here))
    firsts = live.groupBy(slot_of("key", cuts).alias("slot")).agg(F.min("key").alias("first"))
    after = Window.orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    later = log.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("slot")).join(firsts, "slot", "left").select("slot", F.min("first").over(after).alias("later"))
    key = F.when(F.col("target").isNotNull(), F.coalesce("next", "later"))
    return found.where("asked").join(F.broadcast(later), "slot").select("target", key.alias("key"))


def ordered(log: DataFrame, with_tombstones: bool = False) -> DataFrame:
    """All keys in order, with (key, op, value); deletions only if asked for."""
    rows = latest(log)
    return (rows if with_tombstones else rows.where(F.col("op") == PUT)).select("key", "op", "value").orderBy("key")
