"""Queries that go through a Store: the change log of `events` is appended, flushed, compacted, deleted from and reopened.

A store lies in the shared folder, under a name of its own, as the returned rows are read from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction
from ..options import Options
from ..sources.files import shared_dir
from ..store import Store
from .catalog import WITH, change_log

PARTS = 4
_BY_HAND = 1 << 62  # bytes: runs are only written by flush()


def _open(spark: SparkSession, path: str | None = None) -> Store:
    path = path or f"{shared_dir(spark)}/ledgerline-store-{uuid.uuid4().hex}"
    return Store(spark, Options(db_path=path, memtable_size_threshold=_BY_HAND, level0_compaction_trigger=PARTS, level1_max_bytes=_BY_HAND))


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The change log in PARTS ranges of seq; together they are the whole log."""
    log = change_log(spark, sf_dir).select("seq", "op", "key", "value")
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return []
    cuts = [low + (high - low + 1) * i // PARTS for i in range(PARTS + 1)]
    return [log.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _append_runs(db: Store, parts: list[DataFrame]) -> None:
    for part in parts:
        db.append(part.withColumnRenamed("seq", "n"), order_by="n")
        db.flush()


def store_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four appends and flushes: every run's file number, and its changes in key order as its file has them."""
    db = _open(spark)
    _append_runs(db, _parts(spark, sf_dir))
    runs = [db.run(f).select(F.lit(f.file_number).cast("long").alias("file_number"), "key", "op", "value") for f in db.state.files]
    out = spark.createDataFrame([], "file_number long, key string, op string, value string")
    for run in runs:
        out = out.unionByName(run)
    return out


def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of the runs after four flushes."""
    db = _open(spark)
    _append_runs(db, _parts(spark, sf_dir))
    return db.manifest_frame().select("level", "file_number", "file_size", "num_entries", "smallest_key", "largest_key")


def store_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task that is due after a compaction and four more flushes: its runs, and whether deletions go."""
    db = _open(spark)
    parts = _parts(spark, sf_dir)
    _append_runs(db, parts)
    db.compact()
    _append_runs(db, parts)
    task = compaction.pick(db.state, db.options)
    rows = [(f.file_number, f.level, task.target_level, f.num_entries, task.drop_tombstones) for f in task.inputs] if task else []
    return spark.createDataFrame(rows, "file_number long, level int, target_level int, num_entries long, drop_tombstones boolean")


def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four level-0 runs compacted to level 1, without deletions: the entries of the run that is left."""
    db = _open(spark)
    _append_runs(db, _parts(spark, sf_dir))
    db.compact()
    out = spark.createDataFrame([], "level int, key string, op string, value string")
    for f in db.state.files:
        out = out.unionByName(db.run(f).select(F.lit(f.level).alias("level"), "key", "op", "value"))
    return out


def store_delete_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the log flushed, the second left in the log, then all keys whose value has an
    even number of bytes deleted, and the store closed and opened again: every key's lookup."""
    db = _open(spark)
    parts = _parts(spark, sf_dir)
    _append_runs(db, parts[: PARTS // 2])
    for part in parts[PARTS // 2 :]:
        db.append(part.withColumnRenamed("seq", "n"), order_by="n")
    db.delete_many(db.current().where(F.octet_length("value") % 2 == 0).select("key"))
    db.close()
    again = _open(spark, db.options.db_path)
    return again.multi_get(change_log(spark, sf_dir).select("key").distinct())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (store_flush, store_manifest, store_pick, store_compact, store_delete_reopen)}

_PARTED = f"""{WITH}, ends AS (SELECT min(seq) AS low, max(seq) - min(seq) + 1 AS width FROM log),
parted AS (SELECT log.*, (SELECT count(*) FROM range(1, {PARTS}) r WHERE log.seq >= ends.low + ends.width * r.range // {PARTS}) + 1 AS file_number FROM log, ends),
flushed AS (SELECT CAST(file_number AS BIGINT) AS file_number, key, op, value FROM (SELECT *, row_number() OVER (PARTITION BY file_number, key ORDER BY seq DESC) AS n FROM parted) WHERE n = 1),
files AS (SELECT file_number, count(*) AS num_entries, min(key) AS smallest_key, max(key) AS largest_key,
    CAST(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS file_size FROM flushed GROUP BY file_number)"""

ORACLES: dict[str, str] = {
    "store_flush": f"{_PARTED} SELECT * FROM flushed",
    "store_manifest": f"{_PARTED} SELECT CAST(0 AS INTEGER) AS level, file_number, file_size, num_entries, smallest_key, largest_key FROM files",
    "store_pick": f"{_PARTED} SELECT file_number + {PARTS + 1} AS file_number, CAST(0 AS INTEGER) AS level, CAST(1 AS INTEGER) AS target_level, num_entries, true AS drop_tombstones FROM files UNION ALL SELECT {PARTS + 1}, 1, 1, count(*), true FROM cur",
    "store_compact": f"{WITH} SELECT CAST(1 AS INTEGER) AS level, key, op, value FROM newest WHERE op = 'PUT'",
    "store_delete_reopen": f"{WITH}, kept AS (SELECT * FROM cur WHERE octet_length(encode(value)) % 2 <> 0) SELECT p.key, k.value, CASE WHEN k.key IS NULL THEN 'NotFound' ELSE 'OK' END AS status FROM (SELECT DISTINCT key FROM log) p LEFT JOIN kept k ON p.key = k.key",
}
