"""Queries over the driver's tables, built from the operators, and the same queries as SQL for the oracle.

LOG is the change log that `events` holds: seq is the event's id, the key its user, and an error deletes the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bloom
from ..functions.codec import CASTAGNOLI, MASK_DELTA, MURMUR_ADD, MURMUR_C1, MURMUR_C2, MURMUR_MIX, MURMUR_SEED, crc32c_udf, mask_crc_column, murmur3_udf, unmask_crc_column, varint_length
from ..functions.keys import byte_length, padded
from ..operators import blocks, manifest, ranks, reads, resolve
from ..operators.runs import flush_rows, measures
from ..sources.wal import valid_prefix
from ..streaming.ingest import latest_state_of

RUN_EVENTS = 1000
ROLLOVER_BYTES = 64 * 1024


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG: seq, op, key, value and run_id, which is the event's thousand."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(gone, "DELETE").otherwise("PUT").alias("op"),
        padded("user:", "user_id", 8).alias("key"),
        F.when(~gone, F.col("props")).alias("value"),
        F.floor(F.col("event_id") / RUN_EVENTS).cast("long").alias("run_id"),
        "value",
    ).toDF("seq", "op", "key", "value", "run_id", "metric")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_log(spark, sf_dir).select("seq", "op", "key", "value")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUN: the newest change of each key in each run, deletions kept."""
    return flush_rows(change_log(spark, sf_dir), "run_id")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """META: entries, key range and bytes of each run."""
    return _runs(spark, sf_dir).groupBy("run_id").agg(*measures()).withColumnRenamed("file_size", "bytes")


def current_state(spark, sf_dir):
    return resolve.current(_log(spark, sf_dir))


def current_state_window(spark, sf_dir):
    return resolve.latest_by_window(_log(spark, sf_dir)).where("op = 'PUT'").select("key", "value", "seq")


def point_get(spark, sf_dir):
    """The value of the first live key."""
    log = _log(spark, sf_dir)
    key = resolve.current(log).agg(F.min("key")).first()[0]
    return reads.get(log, key)


def multi_get(spark, sf_dir):
    probes = spark.read.parquet(f"{sf_dir}/events.parquet").select(padded("user:", "user_id", 8).alias("key")).distinct()
    return reads.multi_get(_log(spark, sf_dir), probes)


def range_scan(spark, sf_dir):
    return reads.scan(_log(spark, sf_dir), "user:00000010", "user:00000020")


def empty_scan(spark, sf_dir):
    return reads.scan(_log(spark, sf_dir), "user:00000020", "user:00000010")


def seek(spark, sf_dir):
    return reads.seek(_log(spark, sf_dir), "user:00000007x")


def tombstones(spark, sf_dir):
    return resolve.tombstones(_log(spark, sf_dir))


def flush_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


def minor_compaction(spark, sf_dir):
    """Every four runs merged to one, the newest change first, deletions kept."""
    runs = _runs(spark, sf_dir).withColumn("merged_run", F.floor(F.col("run_id") / 4).cast("long"))
    return resolve.merge_runs([runs], by=("merged_run",)).select("merged_run", "key", "op", "value", "seq")


def major_compaction(spark, sf_dir):
    return resolve.merge_runs([_runs(spark, sf_dir)], drop_tombstones=True).select("key", "value", "seq")


def run_union(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return runs.where("run_id % 2 = 0").unionByName(runs.where("run_id % 2 <> 0"))


def run_stats(spark, sf_dir):
    return _meta(spark, sf_dir)


def run_overlap(spark, sf_dir):
    """Pairs of runs with overlapping key ranges; META has a row a run."""
    rows = _meta(spark, sf_dir).select(F.col("run_id").alias("file_number"), "smallest_key", "largest_key")
    return manifest.overlapping(rows).toDF("left_run", "right_run")


def _levels(spark, sf_dir):
    """The first half of the runs at level 1, the rest at level 0."""
    meta = _meta(spark, sf_dir)
    last = meta.agg(F.max("run_id")).scalar()
    level = F.when(F.col("run_id") * 2 <= last, 1).otherwise(0)
    return meta.select(level.alias("level"), F.col("bytes").alias("file_size"), "num_entries")


def level_stats(spark, sf_dir):
    found = manifest.level_stats(_levels(spark, sf_dir))
    return found.select(F.col("level").cast("int").alias("level"), "num_files", F.col("bytes").cast("long").alias("bytes"), F.col("num_entries").cast("long").alias("num_entries"))


def pick_compaction(spark, sf_dir):
    """Which levels are due: 4 runs at level 0, more than 16 KiB at level 1."""
    due = F.when(F.col("level") == 0, F.col("num_files") >= 4).otherwise(F.col("bytes") > 16384)
    return level_stats(spark, sf_dir).select("level", "num_files", "bytes", due.alias("due"))


def wal_prefix_replay(spark, sf_dir):
    """The state that is replayed from a log whose first damaged record is the first event of value over 100."""
    log = change_log(spark, sf_dir)
    return resolve.current(valid_prefix(log, F.col("metric") > 100).select("seq", "op", "key", "value"))


def multi_seek(spark, sf_dir):
    """For every user, the first live key after theirs."""
    probes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(padded("user:", "user_id", 8), F.lit("!")).alias("target")).distinct()
    return reads.multi_seek(_log(spark, sf_dir), probes)


def ordered_iteration(spark, sf_dir):
    live = resolve.current(_log(spark, sf_dir)).select("key")
    return ranks.numbered(live, "key", out="rn", before="previous_key")


def memtable_iteration(spark, sf_dir):
    """All keys with their newest change, deletions among them."""
    return reads.ordered(_log(spark, sf_dir), with_tombstones=True)


def varint_lengths(spark, sf_dir):
    """Bytes that varints of key and value lengths take in the log."""
    rows = _log(spark, sf_dir)
    return rows.agg(F.sum(varint_length(byte_length("key"))).cast("long").alias("key_varint_bytes"), F.sum(varint_length(byte_length("value"))).cast("long").alias("value_varint_bytes"), F.max(varint_length(byte_length("value"))).alias("longest"))


def varint_boundaries(spark, sf_dir):
    """Varint lengths of order keys and their powers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    n = F.col("o_orderkey") * F.col("o_orderkey") * 64
    return orders.select("o_orderkey", varint_length(F.col("o_orderkey")).alias("one"), varint_length(n).alias("squared"))


def memtable_rollover(spark, sf_dir):
    """Batches by running bytes: sums are taken by thousand first, so that no task sees the whole log."""
    log = change_log(spark, sf_dir).withColumn("size", byte_length("key") + byte_length("value"))
    base = Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = log.groupBy("run_id").agg(F.sum("size").alias("s")).select(F.col("run_id").alias("r"), F.coalesce(F.sum("s").over(base), F.lit(0)).alias("base"))
    inner = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("cum", F.sum("size").over(inner)).join(sums, F.col("run_id") == F.col("r"))
    batch = F.floor((F.col("base") + F.col("cum")) / ROLLOVER_BYTES).cast("long").alias("batch")
    return rows.groupBy(batch).agg(F.count("*").alias("changes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("size").cast("long").alias("bytes"))


def prefix_compression(spark, sf_dir):
    return blocks.prefix_compression(resolve.current(_log(spark, sf_dir)).select("key", "value")).select("key", "rn", "shared", "non_shared")


def sparse_index(spark, sf_dir):
    return blocks.sparse_index(resolve.current(_log(spark, sf_dir)).select("key"))


def block_cuts(spark, sf_dir):
    """Blocks of 4 KiB of every run, by walking the run."""
    return blocks.block_cuts(_runs(spark, sf_dir).select("run_id", "key", "value"))


def put_after_delete(spark, sf_dir):
    """Puts that directly follow a deletion, by key."""
    w = Window.partitionBy("key").orderBy("seq")
    rows = _log(spark, sf_dir).select("key", "seq", "op").withColumn("last", F.lag("op").over(w))
    revived = F.when((F.col("op") == "PUT") & (F.col("last") == "DELETE"), 1).otherwise(0)
    return rows.groupBy("key").agg(F.sum(revived).cast("long").alias("revivals"))


def kv_orders(spark, sf_dir):
    """Orders as keyed rows; scans [100, 200) of their numbers. Padded keys keep the numbers' order, so the range goes to Parquet as numbers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where((F.col("o_orderkey") >= 100) & (F.col("o_orderkey") < 200))
    log = orders.select(F.col("o_orderkey").alias("seq"), F.lit("PUT").alias("op"), padded("key_", "o_orderkey", 10).alias("key"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("value"))
    return reads.scan(log, "key_0000000100", "key_0000000200")


def lineitem_versions(spark, sf_dir):
    """Line items as versions of (order, line): the newest by ship date, price and supplier."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.concat(padded("", "l_orderkey", 10), F.lit(":"), F.col("l_linenumber").cast("string")).alias("key")
    newest = F.max(F.struct("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey")).alias("n")
    return rows.groupBy(key).agg(newest, F.count("*").alias("versions")).select("key", "versions", "n.l_extendedprice", "n.l_partkey", "n.l_suppkey")


def conversations_ordered(spark, sf_dir):
    """Turns under composite keys, in the order of a scan."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = F.concat(padded("", "conv_id", 8), F.lit(":"), padded("", "turn", 4))
    log = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("PUT").alias("op"), key.alias("key"), F.col("role").alias("value"))
    return reads.scan(log, "0", ":")  # the byte after the digits


def labels_multi_get(spark, sf_dir):
    """Documents looked up in labels; many are missing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    log = labels.select(F.col("doc_id").alias("seq"), F.lit("PUT").alias("op"), padded("doc:", "doc_id", 10).alias("key"), F.col("quality").cast("string").alias("value"))
    probes = spark.read.parquet(f"{sf_dir}/documents.parquet").select(padded("doc:", "doc_id", 10).alias("key"))
    return reads.multi_get(log, probes)


def bloom_no_false_negatives(spark, sf_dir):
    """A filter for every run: its own keys that it denies, none, and whether it admits few enough of as many others."""
    found = bloom.per_run(_runs(spark, sf_dir))
    few = F.sum("false_hits").over(Window.partitionBy()) <= F.sum("keys").over(Window.partitionBy()) * 0.03 + 3  # a row a run
    return found.select("run_id", "misses", "keys", few.alias("few_false_hits"))


def crc32c(spark, sf_dir):
    """Checksums of the log's keys, masked and unmasked again."""
    rows = _log(spark, sf_dir).select("key").distinct().withColumn("crc", crc32c_udf(F.col("key").cast("binary")))
    return rows.withColumn("masked", mask_crc_column(F.col("crc"))).withColumn("unmasked", unmask_crc_column(F.col("masked")))


def murmur3(spark, sf_dir):
    return _log(spark, sf_dir).select("key").distinct().withColumn("hash", murmur3_udf(F.col("key").cast("binary")))


def flush_once(spark, sf_dir):
    """The whole log as one run."""
    return flush_rows(_log(spark, sf_dir)).select("key", "op", "value", "seq")


def stream_latest_state(spark, sf_dir):
    """current_state, kept by a stream over the events."""
    return latest_state_of(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        current_state, current_state_window, point_get, multi_get, range_scan, empty_scan, seek, tombstones, flush_runs,
        minor_compaction, major_compaction, run_union, run_stats, run_overlap, level_stats, pick_compaction,
        wal_prefix_replay, multi_seek, ordered_iteration, memtable_iteration, varint_lengths, varint_boundaries,
        memtable_rollover, prefix_compression, sparse_index, block_cuts, put_after_delete, kv_orders, lineitem_versions,
        conversations_ordered, labels_multi_get, bloom_no_false_negatives, crc32c, murmur3, flush_once,
        stream_latest_state,
    )
}

WITH = """
WITH log AS (
    SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op,
        'user:' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key,
        CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value,
        CAST(floor(event_id / 1000) AS BIGINT) AS run_id, value AS metric
    FROM events),
newest AS (SELECT key, op, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM log) WHERE n = 1),
cur AS (SELECT key, value, seq FROM newest WHERE op = 'PUT'),
run AS (SELECT run_id, seq, op, key, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) AS n FROM log) WHERE n = 1),
sized AS (SELECT *, CAST(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) AS BIGINT) AS size FROM run),
meta AS (SELECT run_id, count(*) AS num_entries, min(key) AS smallest_key, max(key) AS largest_key, CAST(sum(size) AS BIGINT) AS bytes FROM sized GROUP BY run_id),
levels AS (SELECT CASE WHEN run_id * 2 <= (SELECT max(run_id) FROM meta) THEN 1 ELSE 0 END AS level, bytes, num_entries FROM meta),
stats AS (SELECT CAST(level AS INTEGER) AS level, count(*) AS num_files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(num_entries) AS BIGINT) AS num_entries FROM levels GROUP BY level)
"""


def _varint(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} < {1 << (7 * i)} THEN {i}" for i in range(1, 9)) + " ELSE 9 END"


_PREVIOUS = "lag(key) OVER (ORDER BY key)"
_SHARED = "coalesce(list_min(list_filter(range(1, least(length(key), length(prev)) + 1), lambda i: key[i] <> prev[i])) - 1, least(length(key), length(prev)))"

# Checksums and hashes by 32-bit steps in UBIGINT; keys are ASCII.
_BYTES = "keys AS (SELECT key, list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS UBIGINT)) AS b FROM (SELECT DISTINCT key FROM log))"
_LOW = "CAST(4294967295 AS UBIGINT)"


def _turn(x: str, n: int) -> str:
    return f"(((({x}) << {n}) | (({x}) >> {32 - n})) & {_LOW})"


def _times(x: str, factor: int) -> str:
    return f"((({x}) * CAST({factor} AS UBIGINT)) & {_LOW})"


def _scrambled(k: str) -> str:
    return _times(_turn(_times(k, MURMUR_C1), 15), MURMUR_C2)


# One byte's remainder by the reflected Castagnoli polynomial, for all 256 bytes.
_CRC = f"""{WITH.replace("WITH", "WITH RECURSIVE", 1)}, {_BYTES},
bit AS (SELECT CAST(range AS UBIGINT) AS byte, CAST(range AS UBIGINT) AS c, 0 AS n FROM range(256)
    UNION ALL SELECT byte, xor(c >> 1, CASE WHEN c & 1 = 1 THEN CAST({CASTAGNOLI} AS UBIGINT) ELSE CAST(0 AS UBIGINT) END), n + 1 FROM bit WHERE n < 8),
t AS (SELECT list(c ORDER BY byte) AS t FROM bit WHERE n = 8),
crcs AS (SELECT key, xor(list_reduce(list_prepend({_LOW}, b), lambda c, x: xor(t[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8)), {_LOW}) AS crc FROM keys, t)"""

_MURMUR = f"""{WITH}, {_BYTES},
words AS (SELECT key, len(b) AS size, list_transform(range(0, len(b) // 4), lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) AS k,
    CAST(coalesce(list_sum(list_transform(range(0, len(b) % 4), lambda i: b[len(b) - len(b) % 4 + i + 1] << (8 * i))), 0) AS UBIGINT) AS tail FROM keys),
whole AS (SELECT key, size, tail, list_reduce(list_prepend(CAST({MURMUR_SEED} AS UBIGINT), list_transform(k, lambda x: {_scrambled("x")})),
    lambda h, x: ({_turn("xor(h, x)", 13)} * 5 + {MURMUR_ADD}) & {_LOW}) AS h FROM words),
ended AS (SELECT key, xor(xor(h, {_scrambled("tail")}), CAST(size AS UBIGINT)) AS h FROM whole),
one AS (SELECT key, {_times("xor(h, h >> 16)", MURMUR_MIX[0])} AS h FROM ended),
two AS (SELECT key, {_times("xor(h, h >> 13)", MURMUR_MIX[1])} AS h FROM one)"""

_CUTS = f"""{WITH.replace("WITH", "WITH RECURSIVE", 1)},
placed AS (SELECT run_id, key, coalesce(octet_length(encode(value)), 0) AS body, row_number() OVER w AS rn, lag(key) OVER w AS prev FROM run WINDOW w AS (PARTITION BY run_id ORDER BY key)),
entry AS (SELECT run_id, key, body, rn, CASE WHEN prev IS NULL THEN 0 ELSE {_SHARED} END AS common FROM placed),
sizes AS (SELECT run_id, key, rn, {_varint("common")} + {_varint("(length(key) - common)")} + {_varint("body")} + length(key) - common + body AS shared_size,
    1 + {_varint("length(key)")} + {_varint("body")} + length(key) + body AS full_size FROM entry),
walk AS (SELECT run_id, key, rn, CAST(0 AS BIGINT) AS block, CAST(full_size AS BIGINT) AS size, CAST(2 AS BIGINT) AS restarts, CAST(1 AS BIGINT) AS entries FROM sizes WHERE rn = 1
    UNION ALL SELECT s.run_id, s.key, s.rn, w.block + cut, CASE WHEN cut = 1 THEN full_size WHEN w.entries % 16 = 0 THEN w.size + full_size ELSE w.size + shared_size END,
        CASE WHEN cut = 1 THEN 2 WHEN w.entries % 16 = 0 THEN w.restarts + 1 ELSE w.restarts END, CASE WHEN cut = 1 THEN 1 ELSE w.entries + 1 END
    FROM (SELECT *, CASE WHEN size + 4 * restarts + 8 >= 4096 THEN 1 ELSE 0 END AS cut FROM walk) w JOIN sizes s ON s.run_id = w.run_id AND s.rn = w.rn + 1)"""

ORACLES: dict[str, str] = {
    "current_state": f"{WITH} SELECT * FROM cur",
    "current_state_window": f"{WITH} SELECT * FROM cur",
    "point_get": f"{WITH} SELECT * FROM cur WHERE key = (SELECT min(key) FROM cur)",
    "multi_get": f"{WITH} SELECT p.key, c.value, CASE WHEN c.key IS NULL THEN 'NotFound' ELSE 'OK' END AS status FROM (SELECT DISTINCT key FROM log) p LEFT JOIN cur c ON p.key = c.key",
    "range_scan": f"{WITH} SELECT key, value FROM cur WHERE key >= 'user:00000010' AND key < 'user:00000020' ORDER BY key",
    "empty_scan": f"{WITH} SELECT key, value FROM cur WHERE key >= 'user:00000020' AND key < 'user:00000010'",
    "seek": f"{WITH} SELECT key, value FROM cur WHERE key >= 'user:00000007x' ORDER BY key LIMIT 1",
    "tombstones": f"{WITH} SELECT key, seq FROM newest WHERE op = 'DELETE'",
    "flush_runs": f"{WITH} SELECT * FROM run",
    "minor_compaction": f"{WITH} SELECT CAST(floor(run_id / 4) AS BIGINT) AS merged_run, key, op, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY floor(run_id / 4), key ORDER BY run_id DESC) AS n FROM run) WHERE n = 1",
    "major_compaction": f"{WITH} SELECT * FROM cur",
    "run_union": f"{WITH} SELECT * FROM run",
    "run_stats": f"{WITH} SELECT * FROM meta",
    "run_overlap": f"{WITH} SELECT a.run_id AS left_run, b.run_id AS right_run FROM meta a JOIN meta b ON a.run_id < b.run_id AND a.smallest_key <= b.largest_key AND a.largest_key >= b.smallest_key",
    "level_stats": f"{WITH} SELECT * FROM stats",
    "pick_compaction": f"{WITH} SELECT level, num_files, bytes, CASE WHEN level = 0 THEN num_files >= 4 ELSE bytes > 16384 END AS due FROM stats",
    "wal_prefix_replay": f"{WITH}, good AS (SELECT * FROM log WHERE seq < coalesce((SELECT min(seq) FROM log WHERE metric > 100), 9223372036854775807)) SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM good) WHERE n = 1 AND op = 'PUT'",
    "multi_seek": f"{WITH} SELECT p.target, min(c.key) AS key FROM (SELECT DISTINCT key || '!' AS target FROM log) p LEFT JOIN cur c ON c.key >= p.target GROUP BY p.target",
    "ordered_iteration": f"{WITH} SELECT key, CAST(row_number() OVER (ORDER BY key) AS BIGINT) AS rn, {_PREVIOUS} AS previous_key FROM cur",
    "memtable_iteration": f"{WITH} SELECT key, op, value FROM newest ORDER BY key",
    "varint_lengths": f"{WITH}, lengths AS (SELECT octet_length(encode(key)) AS k, coalesce(octet_length(encode(value)), 0) AS v FROM log) SELECT CAST(sum({_varint('k')}) AS BIGINT) AS key_varint_bytes, CAST(sum({_varint('v')}) AS BIGINT) AS value_varint_bytes, CAST(max({_varint('v')}) AS INTEGER) AS longest FROM lengths",
    "varint_boundaries": f"SELECT o_orderkey, CAST({_varint('o_orderkey')} AS INTEGER) AS one, CAST({_varint('o_orderkey * o_orderkey * 64')} AS INTEGER) AS squared FROM orders",
    "memtable_rollover": f"{WITH}, bytes AS (SELECT seq, CAST(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) AS BIGINT) AS size FROM log), cum AS (SELECT seq, size, CAST(floor(sum(size) OVER (ORDER BY seq) / 65536.0) AS BIGINT) AS batch FROM bytes) SELECT batch, count(*) AS changes, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(size) AS BIGINT) AS bytes FROM cum GROUP BY batch",
    "prefix_compression": f"{WITH}, placed AS (SELECT key, CAST(row_number() OVER (ORDER BY key) AS BIGINT) AS rn, {_PREVIOUS} AS prev FROM cur), found AS (SELECT key, rn, CASE WHEN (rn - 1) % 16 = 0 THEN 0 ELSE {_SHARED} END AS shared FROM placed) SELECT key, rn, CAST(shared AS INTEGER) AS shared, CAST(length(key) - shared AS INTEGER) AS non_shared FROM found",
    "sparse_index": f"{WITH}, placed AS (SELECT key, CAST(floor((row_number() OVER (ORDER BY key) - 1) / 16) AS BIGINT) AS block FROM cur) SELECT block, max(key) AS last_key, count(*) AS num_entries FROM placed GROUP BY block",
    "put_after_delete": f"{WITH}, seen AS (SELECT key, op, lag(op) OVER (PARTITION BY key ORDER BY seq) AS last FROM log) SELECT key, CAST(sum(CASE WHEN op = 'PUT' AND last = 'DELETE' THEN 1 ELSE 0 END) AS BIGINT) AS revivals FROM seen GROUP BY key",
    "kv_orders": "SELECT 'key_' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderstatus || '|' || o_orderpriority AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200 ORDER BY key",
    "lineitem_versions": "SELECT key, versions, l_extendedprice, l_partkey, l_suppkey FROM (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || ':' || CAST(l_linenumber AS VARCHAR) AS key, l_extendedprice, l_partkey, l_suppkey, row_number() OVER w AS n, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS versions FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC)) WHERE n = 1",
    "conversations_ordered": "SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS key, role AS value FROM conversations ORDER BY key",
    "labels_multi_get": "SELECT 'doc:' || lpad(CAST(d.doc_id AS VARCHAR), 10, '0') AS key, CAST(l.quality AS VARCHAR) AS value, CASE WHEN l.doc_id IS NULL THEN 'NotFound' ELSE 'OK' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "bloom_no_false_negatives": f"{WITH} SELECT run_id, CAST(0 AS BIGINT) AS misses, count(*) AS keys, true AS few_false_hits FROM run GROUP BY run_id",
    "block_cuts": f"{_CUTS} SELECT run_id, block, min(key) AS first_key, max(key) AS last_key, count(*) AS num_entries, CAST(max(size + 4 * restarts + 8) AS BIGINT) AS size FROM walk GROUP BY run_id, block",
    "crc32c": f"{_CRC}, masks AS (SELECT key, crc, ({_turn('crc', 17)} + {MASK_DELTA}) & {_LOW} AS masked FROM crcs) SELECT key, CAST(crc AS BIGINT) AS crc, CAST(masked AS BIGINT) AS masked, CAST(crc AS BIGINT) AS unmasked FROM masks",
    "murmur3": f"{_MURMUR} SELECT key, CAST(xor(h, h >> 16) AS BIGINT) AS hash FROM two",
    "flush_once": f"{WITH} SELECT * FROM newest",
    "stream_latest_state": f"{WITH} SELECT * FROM cur",
}
