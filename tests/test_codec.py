import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import codec
from ledgerline.functions.bloom import BloomFilter, build, probe
from ledgerline.functions.status import Corruption, NotFound, to_string

EDGES = [0, 1, 127, 128, 255, 256, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**32 - 1]


@pytest.mark.parametrize("n", EDGES)
def test_varint_round_trip(n):
    assert codec.decode_varint(codec.encode_varint(n)) == (n, len(codec.encode_varint(n)))
    assert codec.decode_varint(codec.encode_varint(n + 2**40), bits=64)[0] == n + 2**40


def test_varint_truncated():
    with pytest.raises(Corruption):
        codec.decode_varint(codec.encode_varint(300)[:1])


@given(st.binary(max_size=300))
def test_prefixed_and_fixed(data):
    assert codec.decode_prefixed(codec.encode_prefixed(data)) == (data, len(codec.encode_prefixed(data)))
    assert codec.decode_fixed32(codec.encode_fixed32(codec.crc32c(data))) == codec.crc32c(data)
    assert codec.decode_fixed64(codec.encode_fixed64(len(data))) == len(data)


def test_prefixed_truncated():
    with pytest.raises(Corruption):
        codec.decode_prefixed(codec.encode_prefixed(b"hello")[:-1])


@given(st.binary(max_size=60), st.binary(max_size=60))
def test_crc(a, b):
    assert codec.crc32c(b, codec.crc32c(a)) == codec.crc32c(a + b)
    assert codec.unmask_crc(codec.mask_crc(codec.crc32c(a))) == codec.crc32c(a)
    assert codec.mask_crc(codec.crc32c(a)) != codec.crc32c(a)


def test_crc_known():
    assert codec.crc32c(b"123456789") == 0xE3069283
    assert codec.crc32c_many([b"123456789", None, b""]) == [0xE3069283, None, 0]


def test_murmur_known():
    assert codec.murmur3(b"", 0) == 0
    assert codec.murmur3(b"hello", 0) == 0x248BFA47
    assert codec.murmur3(b"hello, world", 0) == 0x149BBB7F


def test_columns(spark):
    rows = spark.createDataFrame([(n,) for n in EDGES], "n long")
    got = rows.select("n", codec.varint_length(F.col("n")).alias("size"), codec.varint_udf("n").alias("raw"), codec.unmask_crc_column(codec.mask_crc_column(F.col("n"))).alias("same")).collect()
    assert all(len(r.raw) == r["size"] == len(codec.encode_varint(r.n)) and r.same == r.n for r in got)


def test_bloom():
    f = BloomFilter(100).update(f"key_{i}".encode() for i in range(100))
    assert f.hashes == 6
    assert all(f.may_contain(f"key_{i}".encode()) for i in range(100))
    assert sum(f.may_contain(f"other_{i}".encode()) for i in range(10_000)) < 300
    again = BloomFilter.deserialize(f.serialize())
    assert again.serialize() == f.serialize() and again.may_contain(b"key_7")
    assert not BloomFilter(10).may_contain(b"x")


def test_bloom_from_frame(spark):
    keys = spark.range(500).select(F.format_string("key_%08d", "id").alias("key"))
    f = build(keys)
    assert f.serialize() == BloomFilter(500).update(f"key_{i:08d}".encode() for i in range(500)).serialize()
    assert probe(keys, "key", f).where("not may_contain").isEmpty()


def test_status():
    assert str(NotFound("k")) == "NotFound: k" == to_string("NotFound", "k")
    assert to_string("OK") == "OK"
