"""Schemas of the change log, of runs and of the manifest."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, DataType, IntegerType, LongType, StringType, StructField, StructType

PUT, DELETE = "PUT", "DELETE"


def key_type(binary: bool = False) -> DataType:
    """Keys and values are text in UTF8_BINARY order, or bytes; both compare as unsigned bytes."""
    return BinaryType() if binary else StringType()


def changelog(binary: bool = False) -> StructType:
    kind = key_type(binary)
    return StructType([StructField("seq", LongType(), False), StructField("op", StringType(), False), StructField("key", kind, False), StructField("value", kind)])


def runs(binary: bool = False) -> StructType:
    return StructType([*changelog(binary).fields, StructField("run_id", LongType(), False), StructField("level", IntegerType(), False)])


def kv(binary: bool = False) -> StructType:
    kind = key_type(binary)
    return StructType([StructField("key", kind, False), StructField("value", kind, False)])


def manifest(binary: bool = False) -> StructType:
    kind = key_type(binary)
    return StructType(
        [
            StructField("level", IntegerType(), False),
            StructField("file_number", LongType(), False),
            StructField("file_size", LongType(), False),
            StructField("num_entries", LongType(), False),
            StructField("smallest_key", kind),
            StructField("largest_key", kind),
            StructField("min_seq", LongType()),
            StructField("max_seq", LongType()),
            StructField("path", StringType(), False),
        ]
    )


LOG_RECORD = StructType([StructField("pos", LongType(), False), StructField("type", IntegerType(), False), StructField("key", BinaryType()), StructField("value", BinaryType()), StructField("stored_crc", LongType())])
