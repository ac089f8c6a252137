"""Packed responses are read back by a decoder of their own."""

import math
import struct

import pytest

from alleloom.plans import messagepack, render


def unpack(data: bytes):
    value, rest = _one(memoryview(data))
    assert not len(rest)
    return value


def _many(n, m, pairs=False):
    out = []
    for _ in range(2 * n if pairs else n):
        x, m = _one(m)
        out.append(x)
    return (dict(zip(out[::2], out[1::2], strict=True)) if pairs else out), m


def _one(m):
    c, m = m[0], m[1:]
    if c < 0x80 or c >= 0xE0:
        return (c if c < 0x80 else c - 256), m
    if c < 0x90:
        return _many(c & 15, m, True)
    if c < 0xA0:
        return _many(c & 15, m)
    if c < 0xC0:
        return bytes(m[: c & 31]).decode(), m[c & 31 :]
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], m
    kinds = {0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if c in kinds:
        n = struct.calcsize(kinds[c])
        return struct.unpack(kinds[c], m[:n])[0], m[n:]
    size = {0xC4: 1, 0xC5: 2, 0xC6: 4, 0xD9: 1, 0xDA: 2, 0xDB: 4, 0xDC: 2, 0xDD: 4, 0xDE: 2, 0xDF: 4}[c]
    n, m = int.from_bytes(m[:size], "big"), m[size:]
    if c < 0xC7:
        return bytes(m[:n]), m[n:]
    return (bytes(m[:n]).decode(), m[n:]) if c < 0xDC else _many(n, m, c >= 0xDE)


def test_values_of_every_form():
    ints = [0, 127, 128, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**64 - 1, -1, -32, -33, -128, -129, -32768, -32769, -(2**31), -(2**31) - 1, -(2**63)]
    for x in [*ints, None, True, False, 0.5, -1e300, "", "ü" * 15, "x" * 31, "x" * 32, "x" * 300, "x" * 70_000, b"", b"a" * 300, b"a" * 70_000, [], list(range(15)), list(range(16)), [None] * 70_000, {}, {"k": [1, {"m": None}]}, {str(k): k for k in range(20)}]:
        got = unpack(messagepack.pack(x))
        assert got == x and type(got) is type(x)
    assert messagepack.pack(127) == b"\x7f" and messagepack.pack(-32) == b"\xe0" and messagepack.pack("a") == b"\xa1a" and messagepack.pack({"a": [None]}) == b"\x81\xa1a\x91\xc0"
    assert math.isnan(unpack(messagepack.pack(math.nan)))
    for wrong in (2**64, object()):
        with pytest.raises((ValueError, TypeError)):
            messagepack.pack(wrong)


def test_a_compact_response_comes_back(spark):
    rows = [("1", i, f"1:{i}_A/C", j, f"1:{j}_A/C", (i * j) / 7 if i else None) for i in range(0, 9, 2) for j in range(i + 1, 12, 3)]
    pairs = spark.createDataFrame(rows, "chrom string, pos1 long, variant1 string, pos2 long, variant2 string, value double")
    compact = render.compact(pairs)
    want = compact.collect()[0].asDict(recursive=True)
    got = [unpack(bytes(r["body"])) for r in messagepack.body(compact, "/next?page=2").collect()]
    assert got == [{"data": want, "error": None, "next": "/next?page=2"}]
    assert list(got[0]["data"]) == ["variants", "chromosomes", "positions", "offsets", "correlations"]
