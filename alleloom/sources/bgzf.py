"""Block-gzipped files (BGZF) read from any block on, and the indexes of their records.

A place in such a file is a virtual offset: the block's place in the file, and the byte's place in the block, in the lower 16 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from ..errors import QueryError

#: Fixed value: how a block begins (gzip with an extra field), and the field's name and length.
MAGIC, FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
#: Greatest bytes of a block, compressed or not.
BLOCK = 1 << 16
#: For each level of the binning scheme, the number of its first bin and the bits of a bin's width.
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
LINEAR = 14


def block_size(head: bytes) -> int:
    """The compressed size of the block that begins with these bytes; 0 if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return 0
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        if head[at : at + 4] == FIELD:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", head, at + 2)[0]
    return 0


def inflate(block: bytes) -> bytes:
    start = 12 + struct.unpack_from("<H", block, 10)[0]
    data = zlib.decompress(block[start:-8], -15)
    if zlib.crc32(data) != struct.unpack_from("<I", block, len(block) - 8)[0]:
        raise QueryError("a block of a compressed file is damaged")
    return data


def is_bgzf(file) -> bool:
    file.seek(0)
    return block_size(file.read(64)) > 0


def first_block(file, at: int) -> int:
    """The place of the first block at or after a place; -1 if there is none. Bytes that only look like a block's head lead to no other block."""
    file.seek(at)
    data = file.read(3 * BLOCK)
    found = data.find(MAGIC)
    while found >= 0:
        size = block_size(data[found : found + 64])
        if size and (found + size == len(data) or block_size(data[found + size : found + size + 64])):
            return at + found
        found = data.find(MAGIC, found + 1)
    return -1


def blocks(file, at: int) -> Iterator[tuple[int, int, bytes]]:
    """``(place, place of the next, bytes)`` of the blocks from a block's place on."""
    file.seek(at)
    held = b""
    while True:
        held += file.read(BLOCK) if len(held) < BLOCK else b""
        size = block_size(held[:64])
        if not size:
            if held:
                raise QueryError("a compressed file isn't one of blocks, or ends within one")
            return
        data = inflate(held[:size])
        yield at, at + size, data
        at, held = at + size, held[size:]


def lines(file, begin: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """``(virtual offset, line)`` of the lines that begin from ``begin`` on and before ``end``; the last one is read to its end."""
    rest, rest_at, place = b"", begin, begin & 0xFFFF
    for at, _, data in blocks(file, begin >> 16):
        while place < len(data):
            here = rest_at if rest else at << 16 | place
            if end is not None and here >= end:
                return
            stop = data.find(b"\n", place)
            if stop < 0:
                rest, rest_at = rest + data[place:], here
                break
            yield here, rest + data[place:stop]
            rest, place = b"", stop + 1
        place = 0
    if rest:
        yield rest_at, rest


def part(file, start: int, stop: int) -> Iterator[bytes]:
    """Lines that begin in the blocks from file place ``start`` up to ``stop``: parts put together are the file, each line once.

    A line belongs to the block in which it begins. Of a part that isn't the first, the beginning up to the first line end belongs to the part before;
    a line that begins with a block belongs to that block if the block before ends with a line end.
    """
    at = first_block(file, start)
    if at < 0 or at >= stop:
        return
    rest, inside = b"", at == 0
    if not inside:
        inside = _ends_with_newline(file, at)
    for place, _, data in blocks(file, at):
        if place >= stop and not rest:
            return
        own = data.split(b"\n")
        if not inside:
            if len(own) == 1:
                continue
            own, inside = own[1:], True
        own[0] = rest + own[0]
        if place >= stop and len(own) > 1:
            yield own[0]
            return
        yield from own[:-1]
        rest = own[-1]
    if rest:
        yield rest


def _ends_with_newline(file, at: int) -> bool:
    """Whether the block before the one at a place ends with a line end."""
    before = max(0, at - BLOCK - 64)
    start = first_block(file, before)
    last = b""
    for place, _, data in blocks(file, start):
        if place >= at:
            break
        last = data or last
    return last.endswith(b"\n")


@dataclass
class Index:
    """An index of records by bins: a tabix index, or one whose bins have other widths (CSI).

    ``names`` of sequences (none in the index of a binary file), for each the chunks of its bins and the least offset of each 16 kb or of each bin;
    ``levels``: the number of the first bin and the bits of a bin's width.
    """

    names: list[str]
    bins: list[dict[int, list[tuple[int, int]]]]
    linear: list[list[int]]
    levels: tuple[tuple[int, int], ...] = LEVELS
    least: list[dict[int, int]] | None = None

    @classmethod
    def parse(cls, data: bytes) -> Index:
        if data[:4] == b"CSI\x01":
            return cls._parse_csi(data)
        if data[:4] != b"TBI\x01":
            raise QueryError("not an index of a block-gzipped file")
        n, *_, length = struct.unpack_from("<8i", data, 4)
        names = [x.decode() for x in data[36 : 36 + length].split(b"\0")[:n]]
        at, bins, linear = 36 + length, [], []
        for _ in range(n):
            own, at = cls._bins(data, at, False)
            count = struct.unpack_from("<i", data, at)[0]
            linear.append(list(struct.unpack_from(f"<{count}Q", data, at + 4)))
            at += 4 + 8 * count
            bins.append({k: chunks for k, (_, chunks) in own.items()})
        return cls(names, bins, linear)

    @classmethod
    def _parse_csi(cls, data: bytes) -> Index:
        bits, depth, length = struct.unpack_from("<3i", data, 4)
        if bits < 1 or depth < 0:
            raise QueryError("a CSI index whose bins have no width")
        names = [x.decode() for x in data[16 + 28 : 16 + length].split(b"\0") if x] if length > 28 else []
        n, at = struct.unpack_from("<i", data, 16 + length)[0], 20 + length
        bins, least = [], []
        for _ in range(n):
            own, at = cls._bins(data, at, True)
            bins.append({k: chunks for k, (_, chunks) in own.items()})
            least.append({k: low for k, (low, _) in own.items()})
        levels = tuple((((1 << 3 * k) - 1) // 7, bits + 3 * (depth - k)) for k in range(depth + 1))
        return cls(names, bins, [[] for _ in bins], levels, least)

    @staticmethod
    def _bins(data: bytes, at: int, with_least: bool) -> tuple[dict[int, tuple[int, list[tuple[int, int]]]], int]:
        out: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        count = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(count):
            number, low, chunks = struct.unpack_from("<IQi", data, at) if with_least else (lambda x: (x[0], 0, x[1]))(struct.unpack_from("<Ii", data, at))
            at += 16 if with_least else 8
            flat = struct.unpack_from(f"<{2 * chunks}Q", data, at)
            out[number] = (low, list(zip(flat[::2], flat[1::2], strict=True)))
            at += 16 * chunks
        return out, at

    @classmethod
    def read(cls, file) -> Index:
        return cls.parse(b"".join(data for _, _, data in blocks(file, 0)))

    def _low(self, at: int, first: int) -> int:
        """An offset before which no record reaches to place ``first``."""
        if self.linear[at]:
            return self.linear[at][min(first >> LINEAR, len(self.linear[at]) - 1)]
        held = self.least[at] if self.least else {}
        return next((held[level + (first >> bits)] for level, bits in reversed(self.levels) if level + (first >> bits) in held), 0)

    def chunks(self, chrom: str | int, start: int, stop: int) -> list[tuple[int, int]]:
        """Virtual offsets between which the records of a region (from 1, both ends included) may be, in order, joined where they meet.

        ``chrom``: a name, or the sequence's number where the index has no names.
        """
        at = chrom if isinstance(chrom, int) else self.names.index(chrom) if chrom in self.names else -1
        if not 0 <= at < len(self.bins) or stop < start:
            return []
        first, last = max(0, start - 1), min(max(0, stop - 1), (1 << self.levels[0][1]) - 1)
        low = self._low(at, first)
        found = sorted(c for level, bits in self.levels for k in range(level + (first >> bits), level + (last >> bits) + 1) for c in self.bins[at].get(k, ()) if c[1] > low)
        out: list[tuple[int, int]] = []
        for begin, end in found:
            begin = max(begin, low)
            if out and begin >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(out[-1][1], end))
            else:
                out.append((begin, end))
        return out

    def starts(self) -> list[int]:
        """Virtual offsets at which records begin, in order."""
        most = max(level + (1 << 3 * k) for k, (level, _) in enumerate(self.levels))
        return sorted({begin for own in self.bins for k, chunks in own.items() if k < most for begin, _ in chunks})


Tabix = Index
