"""Encoders that keep numeric order in key order, and generators of keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def padded(prefix: str, number: Column | str, width: int) -> Column:
    """prefix and the number in decimal, padded with zeros, so that byte order is numeric order."""
    number = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def sequential(spark: SparkSession, count: int, filler: int = 100) -> DataFrame:
    """count pairs: keys key_0000000000 and on, values of filler letters and the number."""
    return spark.range(count).select(F.format_string("key_%010d", F.col("id")).alias("key"), F.concat(F.lit("v" * filler), F.col("id").cast("string")).alias("value"), F.col("id").alias("n"))


def byte_length(column: Column | str) -> Column:
    """Bytes of a key or value; null counts as none."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
