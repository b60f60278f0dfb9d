"""The store: batched puts, deletes, lookups and scans over a change log and leveled runs."""

from __future__ import annotations

import functools
import re
import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions.codec import crc32c_udf
from .functions.status import Closed, Corruption, InvalidArgument, NotFound
from .operators import blocks, compaction, manifest, reads, runs
from .operators.manifest import RunFile
from .operators.ranks import numbered
from .operators.resolve import current, merge_runs
from .options import Options, ReadOptions, WriteOptions
from .schema import DELETE, PUT
from .sources.files import Files


class Store:
    """One writer at a time (a lock); readers work on the manifest version that they saw.

    Changes are appended as batches (the log); once pending bytes reach the threshold they are resolved to a sorted
    run at level 0, and compactions run until none is due. Data is written under new names first and published by
    the rename of a manifest, so a crash leaves either the old or the new state.
    """

    def __init__(self, spark: SparkSession, options: Options | None = None, strict: bool = False, reading: ReadOptions | None = None):
        self.spark, self.options, self.reading = spark, options or Options(), reading or ReadOptions()
        self.files = Files(spark, self.options.db_path)
        self.files.make()
        self._lock, self._open = threading.RLock(), True
        self._log_schema = schema.changelog(self.options.binary).add("stored_crc", "long")
        self._state = manifest.load(self.files)
        self._pending_bytes: int | None = None
        self._recover(strict)

    # --- opening and closing ---------------------------------------------------------------------------------

    def _recover(self, strict: bool) -> None:
        """Keeps the valid prefix of the log; damaged batches and all after them are dropped from the manifest."""
        good: list[str] = []
        for name in self._state.log:
            if self._valid(name):
                good.append(name)
                continue
            if strict:
                raise Corruption(f"log batch {name} is damaged")
            prefix = self._prefix(name)
            if prefix:
                good.append(prefix)
            break
        if tuple(good) != self._state.log:
            self._publish(replace(self._state, log=tuple(good)))
        known = {*self._state.log, *(f.path.split("/")[0] for f in self._state.files)}
        for name in self.files.names():  # leftovers of writes that were never published
            if re.match(r"(log|run)-", name) and name not in known:
                self.files.delete(name)

    def _read_log(self, names: Iterable[str]) -> DataFrame:
        names = list(names)
        if not names:
            return self.spark.createDataFrame([], self._log_schema)
        return self.spark.read.schema(self._log_schema).parquet(*[self.files.full(n) for n in names])

    def _checked(self, name: str) -> DataFrame:
        return self._read_log([name]).withColumn("__ok", F.col("stored_crc") == crc32c_udf(_payload()))

    def _valid(self, name: str) -> bool:
        if not self.files.exists(f"{name}/_SUCCESS"):
            return False
        try:
            return self._checked(name).where("not coalesce(__ok, false)").isEmpty()
        except Exception:  # noqa: BLE001  what Spark raises for a file that it cannot read differs by cause
            return False

    def _prefix(self, name: str) -> str | None:
        """The rows of a damaged batch before its first damaged one, as a batch of their own."""
        try:
            rows = self._checked(name)
            first = rows.where("not coalesce(__ok, false)").agg(F.min("seq")).first()[0]
            good = rows.where(F.col("seq") < F.lit(first)).drop("__ok")
            if first is None or good.isEmpty():
                return None
            kept = f"log-{uuid.uuid4().hex}"
            good.write.parquet(self.files.full(kept))
            return kept
        except Exception:  # noqa: BLE001  nothing of the batch can be read
            return None

    def close(self) -> None:
        """Ends use of the store; pending changes stay in the log. Closing again does nothing."""
        with self._lock:
            self._open = False

    def _check(self) -> None:
        if not self._open:
            raise Closed("store closed")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # --- writing ---------------------------------------------------------------------------------------------

    def _publish(self, state: manifest.Manifest, sync: bool = True) -> None:
        state = replace(state, version=state.version + 1)
        manifest.save(self.files, state, sync)
        manifest.prune(self.files)
        self._state = state

    def put(self, key, value) -> None:
        self.write([(PUT, key, value)])

    def delete(self, key) -> None:
        """Succeeds for absent keys as well."""
        self.write([(DELETE, key, None)])

    def write(self, changes: list[tuple]) -> None:
        """Applies (op, key, value) in the given order, as one batch."""
        kind = schema.key_type(self.options.binary)
        rows = [(i, op, _typed(key, self.options.binary), _typed(value, self.options.binary)) for i, (op, key, value) in enumerate(changes)]
        if any(op not in (PUT, DELETE) or key is None or (op == PUT and value is None) for _, op, key, value in rows):
            raise InvalidArgument("a change needs an op and a key, and a put a value")
        if rows:
            text = kind.simpleString()
            self._append(self.spark.createDataFrame(rows, f"seq long, op string, key {text}, value {text}"), 0, len(rows) - 1)

    def put_many(self, rows: DataFrame, order_by: str | None = None) -> None:
        """Puts all rows (key, value); see append()."""
        self.append(rows.withColumn("op", F.lit(PUT)), order_by)

    def delete_many(self, rows: DataFrame) -> None:
        self.append(rows.select("key", F.lit(None).cast(schema.key_type(self.options.binary)).alias("value"), F.lit(DELETE).alias("op")))

    def append(self, rows: DataFrame, order_by: str | None = None, stream: tuple[str, int] | None = None, write: WriteOptions | None = None) -> None:
        """Appends changes (op, key, value) as one batch.

        order_by names a column of unique whole numbers that orders the changes; the batch's seq are those
        numbers, moved past the last used one. Without it, a key may occur once only. stream names a stream and its
        batch: the manifest that publishes the changes also says that the batch is done, and no batch is applied twice.
        """
        if stream is not None and stream[1] <= dict(self._state.streams).get(stream[0], -1):
            return
        unique = "key" if order_by is None else order_by
        seen = [F.count("*"), F.count_distinct(unique)]
        if order_by is not None:
            rows = rows.withColumn("seq", F.col(order_by).cast("long"))
            seen += [F.min("seq"), F.max("seq")]
        count, distinct, *ends = rows.agg(*seen).first()
        if count != distinct:
            raise InvalidArgument("a key occurs twice; name the column that orders its changes" if order_by is None else f"{order_by} is not unique")
        if order_by is None:
            rows, ends = numbered(rows.select("op", "key", "value"), "key", out="seq"), [1, count]
        if count:
            self._append(rows.select("seq", "op", "key", "value"), *ends, stream, write)

    def _append(self, rows: DataFrame, low: int, high: int, stream: tuple[str, int] | None = None, write: WriteOptions | None = None) -> None:
        """Writes changes whose seq lie in [low, high], moved past the last used number."""
        with self._lock:
            self._check()
            base, name, size = self._state.next_seq, f"log-{uuid.uuid4().hex}", Observation()
            rows = rows.withColumn("seq", F.col("seq") - F.lit(low) + F.lit(base)).observe(size, F.sum(runs.entry_bytes()).alias("bytes"))
            rows.withColumn("stored_crc", crc32c_udf(_payload())).write.parquet(self.files.full(name))
            pending = self.pending_bytes() + (size.get["bytes"] or 0)  # of older batches, then of this one
            streams = self._state.streams if stream is None else tuple({**dict(self._state.streams), stream[0]: stream[1]}.items())
            sync = self.options.sync_wal or (write or WriteOptions()).sync
            self._publish(replace(self._state, next_seq=base + high - low + 1, log=(*self._state.log, name), streams=streams), sync)
            self._pending_bytes = pending
            if pending >= self.options.memtable_size_threshold:
                self.flush()
                self.compact()

    def _bytes_of(self, names: list[str]) -> int:
        return (self._read_log(names).agg(F.sum(runs.entry_bytes())).first()[0] or 0) if names else 0

    def pending_bytes(self) -> int:
        """Key and value bytes of changes that are in no run yet."""
        if self._pending_bytes is None:
            self._pending_bytes = self._bytes_of(list(self._state.log))
        return self._pending_bytes

    def flush(self) -> None:
        """Turns pending changes into a run at level 0; does nothing if there are none."""
        with self._lock:
            self._check()
            if not self._state.log:
                return
            old = self._state.log
            rows = runs.flush_rows(self._read_log(old).select("seq", "op", "key", "value"))
            new = self._write_run(rows, 0, self._state.next_file)
            self._publish(replace(self._state.add(new), log=(), next_file=self._state.next_file + 1))
            self._pending_bytes = 0
            for name in old:
                self.files.delete(name)

    def _write_run(self, rows: DataFrame, level: int, number: int) -> list[RunFile]:
        name = f"run-{number:012d}-{uuid.uuid4().hex[:8]}"
        rows = rows.persist()  # spills to disk; measured first, for the number of files and the Bloom filters' size
        try:
            size = runs.measure(rows)
            if not size["num_entries"]:
                return []
            runs.write_run(rows, self.files.full(name), size["num_entries"], self.options, size["file_size"])
        finally:
            rows.unpersist()
        return [RunFile(level=level, file_number=number, path=name, **size)]

    def _runs(self, files: list[RunFile]) -> DataFrame:
        return runs.read_runs(self.spark, files, self.files.base, schema.changelog(self.options.binary), self.reading)

    def run(self, file: RunFile) -> DataFrame:
        """The entries of one run, deletions among them."""
        self._check()
        return self._runs([file])

    def compact(self) -> int:
        """Compacts until no task is due; returns the number of compactions."""
        done = 0
        with self._lock:
            self._check()
            while task := compaction.pick(self._state, self.options):
                merged = merge_runs([self._runs(task.inputs)], task.drop_tombstones).select("seq", "op", "key", "value")
                new = self._write_run(merged, task.target_level, self._state.next_file)
                self._publish(replace(self._state.remove(f.file_number for f in task.inputs).add(new), next_file=self._state.next_file + 1))
                for f in task.inputs:
                    self.files.delete(f.path)
                done += 1
        return done

    # --- reading ---------------------------------------------------------------------------------------------

    def changes(self, start=None, end=None) -> DataFrame:
        """All changes that can matter for a key (end None) or for [start, end); runs are chosen by the manifest."""
        return self._changes(start, end)[0]

    def _changes(self, start=None, end=None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """changes(), and what gives their live rows: runs that share no key need no resolving, if nothing is pending."""
        self._check()
        state = self._state
        files = list(state.files) if start is None else state.holding(start, end)
        log = self._runs(files)
        if state.log:
            log = self._read_log(state.log).select("seq", "op", "key", "value").unionByName(log)
        return log, runs.live if not state.log and state.disjoint(files) else current

    def get(self, key):
        """The value of a key; NotFound if it is absent or deleted."""
        key = _typed(key, self.options.binary)
        row = reads.get(self.changes(key), key).first()
        if row is None:
            raise NotFound(str(key))
        return bytes(row.value) if self.options.binary else row.value

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(key, value, status) for every row of keys; only runs that overlap the keys' range are opened."""
        low, high = keys.agg(F.min("key"), F.max("key")).first()
        log, resolve = self._changes() if low is None else self._changes(_typed(low, self.options.binary), _after(_typed(high, self.options.binary)))
        return reads.multi_get(log, keys, resolve=resolve)

    def scan(self, start, end) -> DataFrame:
        """Live pairs with start <= key < end, in key order."""
        start, end = _typed(start, self.options.binary), _typed(end, self.options.binary)
        log, resolve = self._changes(start, end)
        return reads.scan(log, start, end, resolve)

    def seek(self, target) -> DataFrame:
        """The first live pair at or after target. The runs' own bounds cut the keys that follow into ranges; they are tried
        in order, ever more of them at once, so that a near key costs a small read."""
        target = _typed(target, self.options.binary)
        bounds, step = self._state.bounds(target), 1
        while bounds:
            end = _after(bounds[min(step, len(bounds)) - 1])
            found = self.scan(target, end).limit(1)
            if not found.isEmpty():
                return found
            bounds, step, target = bounds[step:], 4 * step, end
        return reads.seek(self.changes(), target)

    def current(self) -> DataFrame:
        log, resolve = self._changes()
        return resolve(log)

    def block_cuts(self) -> DataFrame:
        """How the store's runs would lie in blocks of the options' size and restart interval."""
        parts = [self._runs([f]).select(F.lit(f.file_number).cast("long").alias("run_id"), "key", "value") for f in self._state.files]
        rows = functools.reduce(DataFrame.unionByName, parts) if parts else self._runs([]).select(F.lit(0).cast("long").alias("run_id"), "key", "value")
        return blocks.block_cuts(rows, self.options.block_size, self.options.block_restart_interval)

    @property
    def state(self) -> manifest.Manifest:
        return self._state

    def manifest_frame(self) -> DataFrame:
        return self._state.to_frame(self.spark, self.options.binary)

    def register_views(self, prefix: str = "") -> None:
        """Temporary views changelog, current and manifest, for SQL."""
        self.changes().createOrReplaceTempView(f"{prefix}changelog")
        self.current().createOrReplaceTempView(f"{prefix}current")
        self.manifest_frame().createOrReplaceTempView(f"{prefix}manifest")


def _typed(value, binary: bool):
    if value is None:
        return None
    if binary:
        return value.encode() if isinstance(value, str) else bytes(value)
    return value.decode() if isinstance(value, bytes | bytearray) else value


def _after(key):
    """The least key greater than key."""
    return key + ("\0" if isinstance(key, str) else b"\0")


def _payload() -> F.Column:
    """The bytes that a change's checksum covers."""
    return F.concat(F.encode(F.concat_ws("|", F.col("seq").cast("string"), "op", F.octet_length("key").cast("string")), "utf-8"), F.col("key").cast("binary"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")))
