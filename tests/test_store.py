import io
import json
import random
import shutil
import threading
import urllib.error
import urllib.request
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline import cli, sql
from ledgerline.functions.status import Closed, Corruption, InvalidArgument, NotFound
from ledgerline.operators.compaction import pick
from ledgerline.operators.manifest import Manifest, RunFile
from ledgerline.options import Options
from ledgerline.server import Server
from ledgerline.store import Store


@pytest.fixture
def open_store(spark, tmp_path):
    def make(name="db", strict=False, **options):
        return Store(spark, Options(db_path=str(tmp_path / name), **options), strict)

    make.path = tmp_path
    return make


def pairs(df):
    return [(r.key, r.value) for r in df.collect()]


def missing(store, key):
    with pytest.raises(NotFound):
        store.get(key)
    return True


def test_crud_scan_and_reopen(open_store):
    s = open_store()
    s.write([("PUT", k, v) for k, v in zip("abcd", "1234", strict=True)])
    assert s.get("b") == "2" and missing(s, "x")
    assert pairs(s.scan("b", "d")) == [("b", "2"), ("c", "3")]
    assert pairs(s.scan("d", "b")) == [] == pairs(s.scan("b", "b"))
    assert pairs(s.scan("", "b")) == [("a", "1")]
    s.put("b", "two")
    s.delete("c")
    s.delete("never")
    assert s.get("b") == "two" and missing(s, "c")
    s.put("c", "back")
    s.close()
    s.close()
    with pytest.raises(Closed):
        s.put("a", "x")
    s = open_store()
    assert pairs(s.scan("a", "z")) == [("a", "1"), ("b", "two"), ("c", "back"), ("d", "4")]
    assert pairs(s.seek("bb")) == [("c", "back")] and pairs(s.seek("zz")) == []


def test_delete_over_flushed_and_empty_values(open_store):
    s = open_store()
    s.write([("PUT", "a", "1"), ("PUT", "b", ""), ("PUT", "s", "\0TOMBSTONE")])
    s.flush()
    s.flush()
    s.delete("a")
    assert missing(s, "a")
    s.flush()
    assert missing(s, "a") and s.get("b") == "" and s.get("s") == "\0TOMBSTONE"
    assert pairs(s.scan("", "z")) == [("b", ""), ("s", "\0TOMBSTONE")]
    assert [f.level for f in s.state.files] == [0, 0]


def test_versions_in_one_compaction(open_store):
    s = open_store()
    for change in (("PUT", "k", "v1"), ("PUT", "k", "v2"), ("PUT", "gone", "x"), ("DELETE", "gone", None)):
        s.write([change])
        s.flush()
    assert s.compact() == 1
    assert s.get("k") == "v2" and missing(s, "gone")
    assert [f.level for f in s.state.files] == [1]
    assert s._runs(list(s.state.files)).where("op = 'DELETE'").isEmpty()  # nothing older: deletions are dropped


def test_tombstones_kept_while_older_runs_overlap():
    run = lambda n, level, a, b, size=1: RunFile(level, n, size, 1, a, b, 1, 1, f"r{n}")
    o = Options(level1_max_bytes=10)
    m = Manifest(files=tuple([run(i, 0, "a", "m") for i in range(4)] + [run(5, 1, "k", "p"), run(6, 1, "q", "z"), run(7, 2, "b", "c")]))
    task = pick(m, o)
    assert {f.file_number for f in task.targets} == {5} and not task.drop_tombstones
    assert pick(m.remove([7]), o).drop_tombstones
    assert pick(m.remove([0]), o) is None
    big = Manifest(files=(run(1, 1, "a", "c", 11), run(2, 2, "b", "x"), run(3, 2, "y", "z")))
    task = pick(big, o)
    assert (task.source_level, task.target_level, [f.file_number for f in task.targets]) == (1, 2, [2])
    assert pick(Manifest(files=(run(1, 0, "", "", 1),) * 4), o).target_level == 1  # the empty key is a key
    assert [f.file_number for f in big.holding("bb")] == [1, 2] and [f.file_number for f in big.holding("d", "y")] == [2]


@pytest.mark.parametrize("binary", [False, True])
def test_odd_keys(open_store, binary):
    keys = ["", " ", "a b", 'q"uote', "new\nline", "nul\0", "é", "z" * 1000]
    if binary:
        keys = [k.encode() for k in keys] + [b"\x80", b"\xff", bytes(range(128, 256))]
    s = open_store(binary=binary)
    s.write([("PUT", k, k) for k in keys])
    s.flush()
    s.close()
    s = open_store(binary=binary)
    got = [(bytes(a), bytes(b)) if binary else (a, b) for a, b in pairs(s.current().orderBy("key").select("key", "value"))]
    want = sorted(keys, key=lambda k: k if binary else k.encode())
    assert [k for k, _ in got] == want and all(a == b for a, b in got)
    for k in keys:
        assert s.get(k) == k


def test_random_changes_match_a_dict(open_store):
    options = {"memtable_size_threshold": 1500, "level1_max_bytes": 2500, "level0_compaction_trigger": 2}
    s, model, rng = open_store(**options), {}, random.Random(11)
    for step in range(10):
        changes = []
        for _ in range(25):
            k = f"k{rng.randrange(60):03d}"
            if rng.random() < 0.3:
                changes.append(("DELETE", k, None))
                model.pop(k, None)
            else:
                changes.append(("PUT", k, "v" * rng.randrange(60)))
                model[k] = changes[-1][2]
        s.write(changes)
        if step % 3 == 2:
            s.close()
            s = open_store(**options)
        if step % 4 == 3:
            s.flush()
            s.compact()
        assert dict(pairs(s.scan("k", "l"))) == model
    assert len(s.state.at_level(0)) < 2 and len(s.state.files) >= 1


def test_batches_from_frames(spark, open_store):
    s = open_store()
    rows = spark.range(200).select(F.format_string("key_%08d", "id").alias("key"), F.concat(F.lit("val_"), "id").alias("value"), "id")
    s.put_many(rows.drop("id"))
    s.put_many(rows.withColumn("value", F.lit("new")).where("id < 50"), order_by="id")
    s.delete_many(rows.where("id >= 100").select("key"))
    assert s.current().count() == 100
    probes = spark.createDataFrame([("key_00000007",), ("key_00000077",), ("key_00000177",), ("none",)], "key string")
    assert {(r.key, r.value, r.status) for r in s.multi_get(probes).collect()} == {("key_00000007", "new", "OK"), ("key_00000077", "val_77", "OK"), ("key_00000177", None, "NotFound"), ("none", None, "NotFound")}
    twice = spark.createDataFrame([("k", "1", 1), ("k", "2", 2)], "key string, value string, n int")
    with pytest.raises(InvalidArgument):
        s.put_many(twice)
    s.put_many(twice, order_by="n")
    assert s.get("k") == "2"
    with pytest.raises(InvalidArgument):
        s.put_many(twice.withColumn("n", F.lit(1)), order_by="n")
    seqs = [r.seq for r in s.changes().select("seq").collect()]
    assert len(seqs) == len(set(seqs))
    assert {r.key for r in sql.query(s, "SELECT key FROM current WHERE key LIKE 'key_0000000%'").collect()} == {f"key_{i:08d}" for i in range(10)}
    found = sql.query(s, "SELECT key FROM scan('key_00000010', 'key_00000013') ORDER BY key")
    assert [r.key for r in found.collect()] == ["key_00000010", "key_00000011", "key_00000012"]
    assert "GreaterThanOrEqual(key,key_00000010)" in found._jdf.queryExecution().executedPlan().toString()


def test_damaged_log(open_store, spark):
    s = open_store()
    for i in range(3):
        s.write([("PUT", f"key{i}", f"value{i}")])
    last = s.state.log[-1]
    s.close()
    for part in (open_store.path / "db" / last).glob("*.parquet"):
        part.write_bytes(part.read_bytes()[:-10])
    with pytest.raises(Corruption):
        open_store(strict=True)
    s = open_store()
    assert [k for k, _ in pairs(s.scan("", "z"))] == ["key0", "key1"]
    s.put("later", "x")
    s.close()
    s = open_store(strict=True)  # what was written after the recovery is kept
    assert [k for k, _ in pairs(s.scan("", "z"))] == ["key0", "key1", "later"]


def test_damaged_record_in_a_batch(open_store, spark):
    s = open_store()
    s.write([("PUT", f"key{i}", "v") for i in range(6)])
    name, folder = s.state.log[0], open_store.path / "db"
    rows = s._read_log([name]).withColumn("value", F.when(F.col("key") == "key4", "changed").otherwise(F.col("value")))
    rows.write.parquet(str(folder / "other"))
    s.close()
    shutil.rmtree(folder / name)
    Path(folder / "other").rename(folder / name)
    s = open_store()
    assert [k for k, _ in pairs(s.scan("", "z"))] == [f"key{i}" for i in range(4)]


def test_unpublished_leftovers_are_ignored(open_store):
    s = open_store()
    s.put("a", "1")
    s._read_log(s.state.log).write.parquet(s.files.full("log-unpublished"))
    s.close()
    s = open_store()
    assert pairs(s.scan("", "z")) == [("a", "1")] and not s.files.exists("log-unpublished")


def test_options():
    with pytest.raises(InvalidArgument):
        Options(max_levels=1)
    with pytest.raises(InvalidArgument):
        Options(block_size=0)
    assert Options().level_limit(3) == 100 * 10 * 1024 * 1024


def test_cli(open_store):
    out = io.StringIO()
    cli.run(open_store(), io.StringIO("put a one two\nGET a\nPUT b \nSCAN a z\nDEL a\nGET a\nPUT\nSCAN a\n\nHELP\nwhat\nquit\nGET b\n"), out)
    text = out.getvalue()
    for part in ("OK\n", "one two\n", "a -> one two\nb -> \n(2 results)\n", "NotFound: a", "Usage: PUT <key> <value>", "Usage: SCAN <start> <end>", "SCAN <start> <end>\n", "Unknown command: WHAT"):
        assert part in text


def test_http(open_store):
    server = Server(open_store(), port=0)
    threading.Thread(target=server.start, daemon=True).start()
    base = f"http://127.0.0.1:{server.port}"

    def call(path, method="GET", body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, method=method, data=body)) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert call("/health") == (200, '{"status":"ok"}')
        assert call("/db/a/b", "PUT", b'{"x":"y"}') == (200, "OK")
        assert call("/db/a/b") == (200, '{"x":"y"}')
        code, body = call("/db?start=a&end=z")
        assert code == 200 and json.loads(body) == [{"key": "a/b", "value": '{"x":"y"}'}]
        assert call("/db?start=a")[0] == 400
        assert call("/db/a/b", "DELETE") == (200, "OK") == call("/db/none", "DELETE")
        assert call("/db/a/b") == (404, "Not Found")
    finally:
        server.stop()


@pytest.mark.parametrize("binary", [False, True])
def test_http_keeps_bytes(open_store, binary):
    store = open_store(binary=binary)
    server = Server(store, port=0)
    threading.Thread(target=server.start, daemon=True).start()
    url = f"http://127.0.0.1:{server.port}/db/k"
    raw = b"\xff\xfeA"
    try:
        ask = urllib.request.Request(url, method="PUT", data=raw)
        if binary:
            urllib.request.urlopen(ask).read()
            assert urllib.request.urlopen(url).read() == raw
            assert json.loads(urllib.request.urlopen(url.replace("/k", "?start=a&end=z")).read()) == [{"key": "k", "value_base64": "//5B"}]
        else:
            with pytest.raises(urllib.error.HTTPError):
                urllib.request.urlopen(ask)
            assert missing(store, "k")
    finally:
        server.stop()


def test_a_stream_batch_is_applied_once(spark, open_store):
    store, rows = open_store(), spark.createDataFrame([(1, "PUT", "k", "v")], "seq long, op string, key string, value string")
    store.append(rows, "seq", stream=("s", 0))
    store.close()  # stopped right after the batch was published
    store = open_store()
    store.append(rows, "seq", stream=("s", 0))
    assert store.changes().count() == 1 and store.state.streams == (("s", 0),)
    store.append(rows, "seq", stream=("s", 1))
    assert store.changes().count() == 2
