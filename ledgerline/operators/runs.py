"""Sorted runs: writing, reading and measuring them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import Options, ReadOptions
from ..schema import PUT
from .manifest import RunFile
from .resolve import latest


def entry_bytes() -> F.Column:
    """Raw bytes of an entry's key and value."""
    return (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")


def write_run(rows: DataFrame, path: str, entries: int, options: Options, bytes_: int | None = None) -> None:
    """Writes rows as files of disjoint key ranges, sorted by key, with a Bloom filter on key sized by its rows."""
    slices = max(1, -(-(bytes_ or 0) // options.level1_max_bytes))
    (
        rows.repartitionByRange(slices, "key")
        .sortWithinPartitions("key")
        .write.option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.bloom.filter.expected.ndv#key", str(max(1, entries // slices)))
        .option("parquet.bloom.filter.fpp#key", f"{math.exp(-options.bloom_bits_per_key * math.log(2) ** 2):.9f}")
        .option("parquet.page.size", str(max(options.block_size, 1024)))
        .parquet(path)
    )


def read_runs(spark: SparkSession, files: list[RunFile], base: str, row_schema, options: ReadOptions | None = None) -> DataFrame:
    """All changes of the given runs; only their paths are opened, and pages are checked if the options say so."""
    if not files:
        return spark.createDataFrame([], row_schema)
    check = str((options or ReadOptions()).verify_checksums).lower()
    return spark.read.schema(row_schema).option("parquet.page.verify-checksum.enabled", check).parquet(*[f"{base}/{f.path}" for f in files])


def measures() -> list[F.Column]:
    """Entries, key range and bytes of rows, as aggregates."""
    return [F.count("*").alias("num_entries"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.sum(entry_bytes()).alias("file_size")]


def measure(rows: DataFrame) -> dict:
    """Entries, key range, bytes and seq range of rows, in one aggregation."""
    r = rows.agg(*measures(), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")).first().asDict()
    return {k: bytes(x) if isinstance(x, bytearray) else 0 if x is None and "key" not in k else x for k, x in r.items()}


def flush_rows(pending: DataFrame, *by: str) -> DataFrame:
    """What a run holds of pending changes: the newest of each key, deletions kept; a run for each value of by."""
    return latest(pending, *by).select(*by, "seq", "op", "key", "value")


def full_scan(run: DataFrame) -> DataFrame:
    """All entries of a run in key order, deletions among them."""
    return run.orderBy("key")


def live(run: DataFrame) -> DataFrame:
    """(key, value, seq) of the live entries of runs that share no key: nothing has to be resolved."""
    return run.where(F.col("op") == PUT).select("key", "value", "seq")
