import bisect
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.codec import encode_varint
from ledgerline.operators import blocks, manifest, ranks, reads, resolve
from ledgerline.operators.manifest import Manifest, RunFile
from ledgerline.plans import catalog
from ledgerline.sources.wal import valid_prefix
from ledgerline.streaming import ingest


@pytest.fixture
def log(spark):
    rows = [(1, "PUT", "a", "1"), (2, "PUT", "b", ""), (3, "DELETE", "a", None), (4, "PUT", "c", "3"), (5, "DELETE", "x", None), (6, "PUT", "c", "4"), (7, "PUT", "d", "5")]
    return spark.createDataFrame(rows, "seq long, op string, key string, value string").repartition(3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_resolve(log):
    want = {("b", "", 2), ("c", "4", 6), ("d", "5", 7)}
    assert {tuple(r) for r in resolve.current(log).collect()} == want
    assert resolve.latest(log).exceptAll(resolve.latest_by_window(log)).isEmpty()
    assert {r.key for r in resolve.tombstones(log).collect()} == {"a", "x"}


def test_merge_two_runs(spark):
    old = spark.createDataFrame([(i, "PUT", f"k{k}", f"old_{k}") for i, k in enumerate((0, 2, 4, 6, 8))], "seq long, op string, key string, value string")
    new = spark.createDataFrame([(10 + i, "PUT", f"k{k}", f"new_{k}") for i, k in enumerate((1, 2, 3))], old.schema)
    got = {r.key: r.value for r in resolve.merge_runs([old, new]).collect()}
    assert len(got) == 7 and got["k2"] == "new_2"


def test_reads(spark, log):
    assert [tuple(r) for r in reads.scan(log, "a", "d").collect()] == [("b", ""), ("c", "4")]
    assert reads.scan(log, "d", "a").isEmpty()
    assert reads.seek(log, "bb").first().key == "c" and reads.seek(log, "e").first() is None
    probes = spark.createDataFrame([("",), ("a",), ("b",), ("bb",), ("e",), ("b",)], "target string")
    for slots in (1, 3, 64):
        got = sorted((r.target, r.key) for r in reads.multi_seek(log, probes, slots).collect())
        assert got == [("", "b"), ("a", "b"), ("b", "b"), ("b", "b"), ("bb", "c"), ("e", None)]
    keys = probes.withColumnRenamed("target", "key")
    for few in (0, 10):
        got = sorted((r.key, r.value, r.status) for r in reads.multi_get(log, keys, few).collect())
        assert got == [("", None, "NotFound"), ("a", None, "NotFound"), ("b", "", "OK"), ("b", "", "OK"), ("bb", None, "NotFound"), ("e", None, "NotFound")]
    assert [r.op for r in reads.ordered(log, with_tombstones=True).collect()] == ["DELETE", "PUT", "PUT", "PUT", "DELETE"]


@pytest.mark.parametrize("slots", [1, 7, 64])
def test_multi_seek_of_more_rows_than_are_sampled(spark, slots):
    n = 40_000
    log = spark.range(n).select(F.col("id").alias("seq"), F.when(F.col("id") % 5 == 0, "DELETE").otherwise("PUT").alias("op"), F.format_string("k%06d", (F.col("id") * 37) % n).alias("key"), F.lit("v").alias("value")).repartition(8)
    targets = [f"k{i:06d}!" for i in range(0, n + 100, 3)] + ["k000009"] * 50 + ["", "k~"]
    live = sorted(f"k{i * 37 % n:06d}" for i in range(n) if i % 5)
    want = [(t, None if t > live[-1] else live[bisect.bisect_left(live, t)]) for t in targets]
    probes = spark.createDataFrame(pd.DataFrame({"target": targets}), "target string")
    got = [tuple(r) for r in reads.multi_seek(log, probes, slots).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_multi_seek_of_nothing_and_of_bytes(spark, log):
    probes = spark.createDataFrame([("b",), (None,)], "target string")
    for few in (log.limit(0), log.where("op = 'DELETE'")):
        assert sorted((r.target or "", r.key) for r in reads.multi_seek(few, probes).collect()) == [("", None), ("b", None)]
    assert reads.multi_seek(log, probes.limit(0)).isEmpty()
    raw = log.withColumn("key", F.concat(F.lit(b"\xff"), F.col("key").cast("binary")))
    asked = spark.createDataFrame([(b"\x7f",), (b"\xffbb",), (b"\xffe",)], "target binary")
    got = {bytes(r.target): r.key and bytes(r.key) for r in reads.multi_seek(raw, asked, 3).collect()}
    assert got == {b"\x7f": b"\xffb", b"\xffbb": b"\xffc", b"\xffe": None}


def test_slots_split_at_the_cuts(spark):
    keys = spark.range(5000).select(F.format_string("k%05d", "id").alias("key")).union(spark.createDataFrame([(None,)], "key string"))
    cuts = ranks.bounds(keys, 16)
    assert cuts == sorted(set(cuts)) and len(cuts) == 15
    got = keys.withColumn("slot", ranks.slot_of("key", cuts)).collect()
    assert all(r.slot == (bisect.bisect_right(cuts, r.key) if r.key else 0) for r in got)
    sizes = Counter(r.slot for r in got)
    assert len(sizes) == 16 and max(sizes.values()) < 3 * 5000 / 16


def test_numbered(spark):
    rows = spark.range(1000).select(F.format_string("k%05d", (F.col("id") * 37) % 1000).alias("key"))
    got = ranks.numbered(rows, "key", before="last", slots=7).orderBy("key").collect()
    assert [r.rn for r in got] == list(range(1, 1001)) and [r["last"] for r in got] == [None, *[r.key for r in got[:-1]]]


def test_filters_reach_parquet_and_op_stays_above(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    text = plan(reads.scan_unordered(stored, "b", "d"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(key,b)" in scan and "LessThan(key,d)" in scan and "PUT" not in scan
    assert "PUT" in text.split("Exchange")[0]  # the filter on op is above the aggregation
    assert "EqualTo(key,b)" in plan(reads.get(stored, "b"))
    assert "value" not in next(line for line in plan(stored.groupBy("key").agg(F.max("seq"))).splitlines() if "ReadSchema" in line).split("ReadSchema")[1]


def test_valid_prefix(log):
    assert [r.seq for r in valid_prefix(log, F.col("seq") == 4).orderBy("seq").collect()] == [1, 2, 3]
    assert valid_prefix(log, F.lit(False)).count() == 7


def test_blocks(spark):
    keys = ["apple", "applesauce", "apply", "banana", "bandana", "é", "ê", ""]
    run = spark.createDataFrame([(0, k, "v" * i) for i, k in enumerate(keys)], "run_id long, key string, value string")
    got = {r.key: r for r in blocks.prefix_compression(run.drop("run_id"), 4).collect()}
    assert [got[k].shared for k in ("", "apple", "applesauce", "apply", "banana", "bandana")] == [0, 0, 5, 4, 0, 3]
    assert got["ê"].shared == 1  # bytes, not characters
    assert [(r.block, r.last_key, r.num_entries) for r in blocks.sparse_index(run, 3).orderBy("block").collect()] == [(0, "applesauce", 3), (1, "bandana", 3), (2, "ê", 2)]


def test_block_cuts_follow_the_recurrence(spark):
    rows = [(r, f"shared_{i:04d}", "x" * (i % 7)) for r in (0, 1) for i in range(150)]
    got = blocks.block_cuts(spark.createDataFrame(pd.DataFrame(rows, columns=["run_id", "key", "value"])), 300, 4).orderBy("run_id", "block").collect()
    want = []
    for r in (0, 1):
        size = count = block = 0
        restarts, last = 1, ""
        for _, key, value in [x for x in rows if x[0] == r]:
            shared = 0
            if count % 4:
                while shared < min(len(key), len(last)) and key[shared] == last[shared]:
                    shared += 1
            else:
                restarts += 1
            size += sum(len(encode_varint(n)) for n in (shared, len(key) - shared, len(value))) + len(key) - shared + len(value)
            last, count = key, count + 1
            if size + 4 * restarts + 8 >= 300:
                want.append((r, block, last, count, size + 4 * restarts + 8))
                block, size, count, restarts = block + 1, 0, 0, 1
        if count:
            want.append((r, block, last, count, size + 4 * restarts + 8))
    assert [(x.run_id, x.block, x.last_key, x.num_entries, x.size) for x in got] == want


def test_manifest_frame(spark):
    files = tuple(RunFile(level, n, 10 * n, n, a, b, n, n, f"run-{n}") for n, (level, a, b) in enumerate([(0, "a", "f"), (0, "e", "k"), (1, "l", "z")], 1))
    frame = Manifest(files=files).to_frame(spark)
    assert {tuple(r) for r in manifest.overlapping(frame).collect()} == {(1, 2)}
    assert {(r.level, r.num_files, r.bytes) for r in manifest.level_stats(frame).collect()} == {(0, 2, 30), (1, 1, 30)}


def test_stream_ingest_is_idempotent(spark, sf, tmp_path):
    from ledgerline.options import Options
    from ledgerline.store import Store

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    store = Store(spark, Options(db_path=str(tmp_path / "db")))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        ingest.ingest(ingest.changes_of(stream), store, str(tmp_path / "check")).awaitTermination()
    want = {(r.key, r.value) for r in catalog.QUERIES["current_state"](spark, sf).collect()}
    assert {(r.key, r.value) for r in store.current().collect()} == want
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = ingest.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").agg(F.sum("changes")).first()[0] == events.count()
