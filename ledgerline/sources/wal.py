"""Binary log files: a checksum, a type, and key and value with varint lengths, record after record."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import crc32c, decode_fixed32, decode_prefixed, encode_fixed32, encode_prefixed
from ..functions.status import Corruption

TYPE_PUT, TYPE_DELETE = 1, 2


def encode_record(kind: int, key: bytes, value: bytes = b"") -> bytes:
    payload = bytes([kind]) + encode_prefixed(key) + encode_prefixed(value)
    return encode_fixed32(crc32c(payload)) + payload


def decode_records(data: bytes, strict: bool = False) -> Iterator[tuple[int, int, bytes, bytes, int]]:
    """(position, type, key, value, stored checksum) of the valid prefix.

    The first damaged record ends it; strict raises Corruption there, for any bytes left over.
    """
    at = 0
    while at < len(data):
        try:
            if at + 5 > len(data):
                raise Corruption("truncated record")
            stored, body = decode_fixed32(data, at), at + 4
            key, after = decode_prefixed(data, body + 1)
            value, after = decode_prefixed(data, after)
            if crc32c(data[body:after]) != stored:
                raise Corruption("checksum mismatch")
        except Corruption:
            if strict:
                raise
            return
        yield at, data[body], key, value, stored
        at = after


def write_log(path: str, records: Iterable[tuple[int, bytes, bytes]]) -> int:
    """Appends records to a local file; returns their number."""
    count = 0
    with open(path, "ab") as file:
        for kind, key, value in records:
            file.write(encode_record(kind, key, value))
            count += 1
    return count


def read_logs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(seq, op, key, value, file, pos) of log files under a path, oldest file first by the number in its name.

    Files are parsed in parallel, one task a file, as a record's place is known only from those before it. Records
    of unknown types are left out. seq numbers the files' records in order: the file's rank, then the position.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = sorted((r.path for r in files.select("path").collect()), key=lambda p: (int((re.findall(r"\d+", p.rpartition("/")[2]) or ["0"])[-1]), p))
    rank = {name: i for i, name in enumerate(names)}

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(rank[name] << 40 | pos, "PUT" if kind == TYPE_PUT else "DELETE", key, value if kind == TYPE_PUT else None, name, pos) for pos, kind, key, value, _ in decode_records(content.as_buffer().to_pybytes(), strict) if kind in (TYPE_PUT, TYPE_DELETE)]
                if rows:
                    types = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["seq", "op", "key", "value", "file", "pos"])

    return files.mapInArrow(parse, "seq long, op string, key binary, value binary, file string, pos long")


def valid_prefix(log: DataFrame, bad: Column) -> DataFrame:
    """Rows of a change log before the first damaged one, in order of seq."""
    first = log.where(bad).agg(F.min("seq")).scalar()
    return log.where(first.isNull() | (F.col("seq") < first))
