"""How a run's entries would lie in blocks: prefix compression, sparse index and block cuts, as analyses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import encode_varint, varint_length
from .ranks import numbered


def shared_prefix(a: Column, b: Column) -> Column:
    """Bytes that two keys have in common at their start; null counts as none."""
    x, y = F.hex(a), F.hex(b)
    size = F.least(F.octet_length(a), F.octet_length(b))
    first_other = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(x, 2 * i - 1, 2) != F.substring(y, 2 * i - 1, 2)))
    return F.when(a.isNull() | b.isNull() | (size == 0), 0).otherwise(F.coalesce(first_other - 1, size)).cast("int")


def prefix_compression(run: DataFrame, restart_interval: int = 16) -> DataFrame:
    """key, rn, shared, non_shared and encoded bytes of each entry; a full key every restart_interval entries."""
    rows = numbered(run, "key", out="rn", before="__last")
    restart = (F.col("rn") - 1) % restart_interval == 0
    rows = rows.withColumn("shared", F.when(restart, 0).otherwise(shared_prefix(F.col("__last"), F.col("key"))).cast("int"))
    rows = rows.withColumn("non_shared", (F.octet_length("key") - F.col("shared")).cast("int"))
    size = F.coalesce(F.octet_length("value"), F.lit(0))
    coded = varint_length(F.col("shared")) + varint_length(F.col("non_shared")) + varint_length(size) + F.col("non_shared") + size
    return rows.withColumn("encoded_bytes", coded.cast("int")).drop("__last")


def sparse_index(run: DataFrame, entries: int = 16) -> DataFrame:
    """block, its last key and its entries, for blocks of a fixed number of entries."""
    rows = numbered(run, "key").withColumn("block", F.floor((F.col("rn") - 1) / entries).cast("long"))
    return rows.groupBy("block").agg(F.max("key").alias("last_key"), F.count("*").alias("num_entries"))


def block_cuts(run: DataFrame, block_size: int = 4096, restart_interval: int = 16, by: str = "run_id") -> DataFrame:
    """(by, block, first_key, last_key, num_entries, size): blocks end once their estimated size reaches block_size.

    Where a block ends depends on where the last one did, so each run is walked in order, by itself, in bounded
    memory: rows arrive sorted and only the open block is held.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run_id, block, size, restarts, count, first, last = None, 0, 0, 0, 0, None, None
        out = []
        for frame in frames:
            for r, key, value in zip(frame[by], frame["key"], frame["value"], strict=True):
                raw = key.encode() if isinstance(key, str) else bytes(key)
                body = 0 if value is None else len(value.encode() if isinstance(value, str) else value)
                if r != run_id:
                    if count:
                        out.append((run_id, block, first, last, count, size + 4 * restarts + 8))
                    run_id, block, size, restarts, count = r, 0, 0, 1, 0
                shared = 0
                if count % restart_interval:
                    before = last.encode() if isinstance(last, str) else bytes(last)
                    shared = next((i for i, (a, b) in enumerate(zip(before, raw, strict=False)) if a != b), min(len(before), len(raw)))
                else:
                    restarts += 1
                    first = key if not count else first
                size += sum(len(encode_varint(n)) for n in (shared, len(raw) - shared, body)) + len(raw) - shared + body
                last, count = key, count + 1
                if size + 4 * restarts + 8 >= block_size:
                    out.append((run_id, block, first, last, count, size + 4 * restarts + 8))
                    block, size, restarts, count = block + 1, 0, 1, 0
        if count:
            out.append((run_id, block, first, last, count, size + 4 * restarts + 8))
        yield pd.DataFrame(out, columns=[by, "block", "first_key", "last_key", "num_entries", "size"])

    key, run_type = run.schema["key"].dataType.simpleString(), run.schema[by].dataType.simpleString()
    rows = run.select(by, "key", "value").repartition(by).sortWithinPartitions(by, "key")
    return rows.mapInPandas(walk, f"{by} {run_type}, block long, first_key {key}, last_key {key}, num_entries long, size long")
