"""Binary variant files (BCF2): typed records over block-gzipped bytes, given as the lines of the text format."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..errors import QueryError
from .bgzf import blocks

#: numpy's kinds of the format's types; texts have type 7.
KINDS = {1: "<i1", 2: "<i2", 3: "<i4", 5: "<f4"}
TEXT = 7


class Bytes:
    """The bytes of a file's blocks from a virtual offset on, which are read as they are asked for."""

    def __init__(self, file, begin: int = 0):
        self.source = blocks(file, begin >> 16)
        self.held, self.at = bytearray(), begin & 0xFFFF  # of the bytes held, those before ``at`` are done
        self.starts, self.places = [], []  # where in ``held`` a block begins, and its place in the file

    def _has(self, n: int) -> bool:
        while len(self.held) - self.at < n:
            block = next(self.source, None)
            if block is None:
                return False
            if block[2]:
                self.starts.append(len(self.held))
                self.places.append(block[0])
                self.held += block[2]
        return True

    def offset(self) -> int | None:
        """The virtual offset of the next byte; null at the end of the file."""
        if not self._has(1):
            return None
        k = bisect_right(self.starts, self.at) - 1
        return self.places[k] << 16 | self.at - self.starts[k]

    def take(self, n: int) -> bytes:
        if not self._has(n):
            raise QueryError("a binary variant file ends within a record")
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        if self.at > 1 << 20:  # blocks that are done
            k = bisect_right(self.starts, self.at) - 1
            gone = self.starts[k]
            del self.held[:gone], self.starts[:k], self.places[:k]
            self.starts = [s - gone for s in self.starts]
            self.at -= gone
        return out


@dataclass
class Header:
    """Names by number, samples, the header's lines and where the first record is."""

    contigs: dict[int, str]
    names: dict[int, str]
    lines: list[str]
    first: int | None

    @classmethod
    def read(cls, file) -> Header:
        data = Bytes(file)
        magic = data.take(5)
        if magic[:4] != b"BCF\x02":
            raise QueryError("not a BCF file")
        text = data.take(struct.unpack("<I", data.take(4))[0]).rstrip(b"\0").decode()
        lines = text.splitlines()
        contigs: dict[int, str] = {}
        names: dict[int, str] = {0: "PASS"}
        for line in lines:
            found = re.match(r"##(contig|FILTER|INFO|FORMAT)=<(.*)>", line)
            if not found:
                continue
            name = re.search(r"(?:^|,)ID=([^,]+)", found[2])[1]
            number = re.search(r"(?:^|,)IDX=(\d+)", found[2])
            held = contigs if found[1] == "contig" else names
            if number:
                held[int(number[1])] = name
            elif name not in held.values():
                held[len(held)] = name
        return cls(contigs, names, lines, data.offset())


def typed(data: bytes, at: int) -> tuple[object, int]:
    """A typed value, text or numbers, and where the next one begins."""
    kind, n, at = _descriptor(data, at)
    if kind == TEXT:
        return data[at : at + n].decode(), at + n
    if not kind:
        return np.zeros(0, np.int32), at
    values = np.frombuffer(data, KINDS[kind], n, at)
    return values, at + n * values.itemsize


def _descriptor(data: bytes, at: int) -> tuple[int, int, int]:
    """Type, number of values, and where they begin."""
    kind, n, at = data[at] & 15, data[at] >> 4, at + 1
    if kind not in (0, TEXT, *KINDS):
        raise QueryError(f"unknown type {kind} in a binary variant file")
    if n == 15:
        size, at = typed(data, at)
        n = int(size[0])
    return kind, n, at


def genotypes(data: bytes, n_format: int, n_samples: int, names: dict[int, str]) -> list[str]:
    """The genotypes of a record's samples as texts, ``.`` where it has none."""
    at = 0
    for _ in range(n_format):
        key, at = typed(data, at)
        kind, n, at = _descriptor(data, at)
        size = n * n_samples * (1 if kind == TEXT else np.dtype(KINDS[kind]).itemsize if kind else 0)
        if names[int(key[0])] == "GT":
            values = np.frombuffer(data, KINDS[kind], n * n_samples, at).reshape(n_samples, n)
            kinds, which = np.unique(values, axis=0, return_inverse=True)
            low = np.iinfo(KINDS[kind]).min
            texts = [_genotype([v for v in row if v != low + 1], low) for row in kinds.tolist()]
            return [texts[k] for k in which.ravel().tolist()]
        at += size
    return ["."] * n_samples


def _genotype(alleles: list[int], missing: int) -> str:
    """An allele's number is half its value less one, and none is zero; an odd value is phased with the one before."""
    out = ""
    for k, v in enumerate(alleles):
        own = "." if v == missing or v >> 1 == 0 else str((v >> 1) - 1)
        out += own if not k else ("|" if v & 1 else "/") + own
    return out or "."


def lines(file, header: Header, begin: int | None, end: int | None = None) -> Iterator[tuple[str, int, str]]:
    """``(chrom, pos, line)`` of the records that begin from a virtual offset on and before ``end``, as text with genotypes only."""
    if begin is None:
        return
    data = Bytes(file, begin)
    while True:
        here = data.offset()
        if here is None or end is not None and here >= end:
            return
        shared, own = struct.unpack("<II", data.take(8))
        fixed, individual = data.take(shared), data.take(own)
        contig, pos, _, _, alleles, formats = struct.unpack_from("<iiifII", fixed)
        at, texts = 24, []
        for _ in range(1 + (alleles >> 16)):
            text, at = typed(fixed, at)
            texts.append(text if isinstance(text, str) and text else ".")
        found = genotypes(individual, formats >> 24, formats & 0xFFFFFF, header.names)
        yield header.contigs[contig], pos + 1, "\t".join([header.contigs[contig], str(pos + 1), texts[0], texts[1], ",".join(texts[2:]) or ".", ".", ".", ".", "GT", *found])
