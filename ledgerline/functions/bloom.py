"""Bloom filters over keys: in memory, and built from a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import murmur3

_M32 = 0xFFFFFFFF
_BLOCK = 1 << 16


def shape(keys: int, bits_per_key: int = 10) -> tuple[int, int]:
    """Bits and hashes of a filter sized for a number of keys."""
    bits = max(keys * bits_per_key, 64)
    return (bits + 7) // 8 * 8, int(max(1.0, min(30.0, bits_per_key * 0.693)))


def positions(key: bytes, bits: int, hashes: int) -> list[int]:
    h = murmur3(key)
    step = ((h >> 17) | (h << 15)) & _M32
    return [((h + i * step) & _M32) % bits for i in range(hashes)]


class BloomFilter:
    def __init__(self, keys: int = 0, bits_per_key: int = 10, *, raw: bytes | None = None, hashes: int | None = None):
        if raw is None:
            self.bits, self.hashes = shape(keys, bits_per_key)
            self.data = bytearray(self.bits // 8)
        else:
            self.bits, self.hashes, self.data = len(raw) * 8, hashes, bytearray(raw)

    def add(self, key: bytes) -> None:
        for p in positions(key, self.bits, self.hashes):
            self.data[p >> 3] |= 1 << (p & 7)

    def update(self, keys: Iterable[bytes]) -> BloomFilter:
        for key in keys:
            self.add(key)
        return self

    def may_contain(self, key: bytes) -> bool:
        return self.bits > 0 and all(self.data[p >> 3] >> (p & 7) & 1 for p in positions(key, self.bits, self.hashes))

    def serialize(self) -> bytes:
        return bytes(self.data) + bytes([self.hashes])

    @classmethod
    def deserialize(cls, raw: bytes) -> BloomFilter:
        return cls(raw=raw[:-1], hashes=raw[-1]) if raw else cls(0)


def _raw(column: pa.Array) -> list[bytes]:
    return [x.encode() if isinstance(x, str) else x for x in column.to_pylist() if x is not None]


def build(keys: DataFrame, bits_per_key: int = 10) -> BloomFilter:
    """A filter of the first column of keys, sized by its number of rows.

    Tasks set bits in blocks of their own; blocks of one place are joined by one group each, and the driver gets
    the filter: bits_per_key bits for every key of the run that it is built for.
    """
    count = keys.count()
    bits, hashes = shape(count, bits_per_key)

    def mark(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for key in _raw(batch.column(0)):
                for p in positions(key, bits, hashes):
                    block = blocks.setdefault(p // 8 // _BLOCK, np.zeros(_BLOCK, np.uint8))
                    block[p // 8 % _BLOCK] |= 1 << (p & 7)
        if blocks:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(blocks), pa.int32()), "bits": pa.array([b.tobytes() for b in blocks.values()], pa.binary())})

    def either(table: pa.Table) -> pa.Table:
        out = np.zeros(_BLOCK, np.uint8)
        for x in table.column("bits"):
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    rows = keys.mapInArrow(mark, "block int, bits binary").groupBy("block").applyInArrow(either, "block int, bits binary").collect()
    out = np.zeros((bits // 8 + _BLOCK - 1) // _BLOCK * _BLOCK, np.uint8)
    for r in rows:
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.bits, np.uint8)
    return BloomFilter(raw=out[: bits // 8].tobytes(), hashes=hashes)


def probe(keys: DataFrame, column: str, bloom: BloomFilter, out: str = "may_contain") -> DataFrame:
    """keys with a boolean column: whether the filter may contain the key."""
    held = keys.sparkSession.sparkContext.broadcast(bloom.serialize())

    @F.pandas_udf("boolean")
    def test(values):
        import pandas as pd

        own = BloomFilter.deserialize(held.value)
        return pd.Series([own.may_contain(v.encode() if isinstance(v, str) else bytes(v)) for v in values])

    return keys.withColumn(out, test(F.col(column)))


def per_run(keys: DataFrame, by: str = "run_id", bits_per_key: int = 10, other: str = "!") -> DataFrame:
    """(by, keys, misses, false_hits): a filter for every run, each run one group (runs are bounded), probed with the
    run's own keys and with as many keys that it does not hold (its own followed by other)."""

    def run(table: pa.Table) -> pa.Table:
        own = sorted(set(_raw(table.column("key"))))
        bloom = BloomFilter(len(own), bits_per_key).update(own)
        held = set(own)
        absent = [k for k in (k + other.encode() for k in own) if k not in held]
        return pa.table({by: table.column(by).slice(0, 1), "keys": [len(own)], "misses": [sum(not bloom.may_contain(k) for k in own)], "false_hits": [sum(map(bloom.may_contain, absent))]})

    return keys.select(by, "key").groupBy(by).applyInArrow(run, f"{by} {keys.schema[by].dataType.simpleString()}, keys long, misses long, false_hits long")
