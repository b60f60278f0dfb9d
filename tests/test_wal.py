import pytest

from ledgerline.functions.status import Corruption
from ledgerline.operators.resolve import current
from ledgerline.sources import wal

THREE = [(1, b"key1", b"value1"), (1, b"key2", b"value2"), (2, b"key3", b"")]


def raw(records):
    return b"".join(wal.encode_record(*r) for r in records)


def parsed(data, strict=False):
    return [(kind, key, value) for _, kind, key, value, _ in wal.decode_records(data, strict)]


def test_order_and_types():
    assert parsed(raw(THREE)) == THREE
    many = [(1, f"key_{i}".encode(), f"val_{i}".encode()) for i in range(100)]
    assert parsed(raw(many), strict=True) == many


def test_truncated_keeps_prefix():
    data = raw(THREE[:2])
    assert parsed(data[: len(data) * 2 // 3]) == THREE[:1]
    for cut in range(1, len(data)):  # any tail at all
        want = 0 if cut < len(raw(THREE[:1])) else 1
        assert len(parsed(data[:cut])) == want
        if cut != len(raw(THREE[:1])):
            with pytest.raises(Corruption):
                parsed(data[:cut], strict=True)


def test_flipped_bit():
    data = bytearray(raw(THREE[:1]))
    data[5] ^= 1
    assert parsed(bytes(data)) == []
    with pytest.raises(Corruption):
        parsed(bytes(data), strict=True)


def test_empty():
    assert parsed(b"", strict=True) == []


def test_read_several_logs(spark, tmp_path):
    wal.write_log(str(tmp_path / "wal_000009.log"), [(1, b"a", b"1"), (1, b"b", b"2"), (7, b"z", b"")])
    wal.write_log(str(tmp_path / "wal_000010.log"), [(2, b"a", b""), (1, b"c", b"\x00\xff")])
    with open(tmp_path / "wal_000010.log", "ab") as f:
        f.write(b"torn")
    log = wal.read_logs(spark, f"file://{tmp_path}")
    assert log.count() == 4
    assert {(bytes(r.key), bytes(r.value)) for r in current(log.select("seq", "op", "key", "value")).collect()} == {(b"b", b"2"), (b"c", b"\x00\xff")}
