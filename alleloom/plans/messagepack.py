"""Responses as MessagePack: maps, arrays, texts, numbers and nulls in the format's shortest forms."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from ..shipping import ship


def _sized(n: int, small: int | None, limit: int, codes: tuple[int | None, int, int]) -> bytes:
    """The head of something with ``n`` parts: one byte for few, else a code and the number in one, two or four bytes."""
    if small is not None and n < limit:
        return bytes([small | n])
    for code, kind, most in zip(codes, ">B >H >I".split(), (1 << 8, 1 << 16, 1 << 32), strict=True):
        if code is not None and n < most:
            return bytes([code]) + struct.pack(kind, n)
    raise ValueError(f"{n} parts are too many")


def _integer(n: int) -> bytes:
    if -32 <= n < 128:
        return struct.pack("b" if n < 0 else "B", n)
    for code, kind, low, high in ((0xCC, ">B", 0, 1 << 8), (0xCD, ">H", 0, 1 << 16), (0xCE, ">I", 0, 1 << 32), (0xCF, ">Q", 0, 1 << 64), (0xD0, ">b", -(1 << 7), 0), (0xD1, ">h", -(1 << 15), 0), (0xD2, ">i", -(1 << 31), 0), (0xD3, ">q", -(1 << 63), 0)):
        if low <= n < high:
            return bytes([code]) + struct.pack(kind, n)
    raise ValueError(f"{n} has over 64 bits")


def pack(value) -> bytes:
    """A value and all in it; floats have 64 bits, keys of maps keep their order."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        return _integer(value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        data = value.encode()
        return _sized(len(data), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + data
    if isinstance(value, bytes | bytearray):
        return _sized(len(value), None, 0, (0xC4, 0xC5, 0xC6)) + bytes(value)
    if isinstance(value, dict):
        return _sized(len(value), 0x80, 16, (None, 0xDE, 0xDF)) + b"".join(pack(x) for kv in value.items() for x in kv)
    if isinstance(value, list | tuple):
        return _sized(len(value), 0x90, 16, (None, 0xDC, 0xDD)) + b"".join(map(pack, value))
    raise TypeError(f"no MessagePack form of {type(value).__name__}")


def body(response: DataFrame, next_url: str = "") -> DataFrame:
    """``body binary``: a response's row (a page at most) as the map of its ``data``, ``error`` and the ``next`` page's address."""
    ship(response.sparkSession)

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack({"data": row, "error": None, "next": next_url}) for row in batch.to_pylist()], pa.binary())], names=["body"])

    return response.mapInArrow(encode, "body binary")
