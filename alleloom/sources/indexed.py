"""A data source of the lines of block-gzipped files, text or binary (BCF, given as text): a region reads the blocks that its index names, a whole file is split into many tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship
from . import bcf, bgzf
from .stores import at_any_place, exists

#: Compressed bytes of a task.
SPLIT = 16 << 20
#: Lines of one Arrow batch at most, and their bytes (about).
BATCH_LINES, BATCH_BYTES = 10_000, 8 << 20


@dataclass
class Part(InputPartition):
    """Blocks of a file from ``begin`` to ``end``: places in the file, or virtual offsets of a region's chunk."""

    path: str
    begin: int
    end: int
    kind: str


class Lines(DataSource):
    """Options: ``paths`` (split by line ends), ``split``, and for a region ``chrom``, ``start`` and ``stop``; or ``header``: only lines before the first record."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(dict(self.options))


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.split = int(options.get("split", SPLIT))
        self.header = options.get("header") == "true"
        self.region = (options["chrom"], int(options["start"]), int(options["stop"])) if "chrom" in options else None

    def partitions(self) -> list[Part]:
        return [p for path in self.paths for p in self._parts(path)]

    def _parts(self, path: str) -> list[Part]:
        with at_any_place(path) as file:
            if self.header:
                return [Part(path, 0, 0, "header")]
            if path.endswith(".bcf"):
                return self._binary_parts(path, file)
            index = self._index(path)
            if self.region and index:
                return [Part(path, a, b, "chunk") for begin, end in index.chunks(*self.region) for a, b in self._cut(file, begin, end)]
            size = file.seek(0, 2)
            size = file.tell() if size is None else size
            return [Part(path, at, min(size, at + self.split), "part") for at in range(0, size, self.split)]

    @staticmethod
    def _index(path: str) -> bgzf.Index | None:
        for ending in ("tbi", "csi"):
            if exists(f"{path}.{ending}"):
                with at_any_place(f"{path}.{ending}") as file:
                    return bgzf.Index.read(file)
        return None

    def _binary_parts(self, path: str, file) -> list[Part]:
        """Records of a binary file have no marks to be found by, so it is split at those that its index knows, and is one task without."""
        header, index = bcf.Header.read(file), self._index(path)
        if header.first is None:
            return []
        if self.region and index:
            number = next((k for k, name in header.contigs.items() if name == self.region[0]), -1)
            return [Part(path, a, b, "binary") for a, b in index.chunks(number, *self.region[1:])]
        places = [header.first]
        for v in index.starts() if index else ():
            if (v >> 16) - (places[-1] >> 16) >= self.split:
                places.append(v)
        return [Part(path, a, b, "binary") for a, b in zip(places, [*places[1:], -1], strict=True)]

    def _cut(self, file, begin: int, end: int) -> list[tuple[int, int]]:
        """A long chunk in pieces at block borders; lines are read from a place up to the next one's."""
        if (end >> 16) - (begin >> 16) <= 2 * self.split:
            return [(begin, end)]
        places = [begin]
        for at in range((begin >> 16) + self.split, (end >> 16) - self.split // 2, self.split):
            block = bgzf.first_block(file, at)
            line = next((v for v in self._line_starts(file, block) if v > places[-1]), None) if block >= 0 else None
            if line is not None and line < end:
                places.append(line)
        return list(zip(places, [*places[1:], end], strict=True))

    @staticmethod
    def _line_starts(file, block: int) -> Iterator[int]:
        """The first line that begins within a block after some line end."""
        for at, _, data in bgzf.blocks(file, block):
            stop = data.find(b"\n")
            if 0 <= stop < len(data) - 1:
                yield at << 16 | stop + 1
                return

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a region without a chunk
            return
        with at_any_place(partition.path) as file:
            held, size = [], 0
            for line in self._lines(file, partition):
                held.append(line)
                size += len(line)
                if len(held) >= BATCH_LINES or size >= BATCH_BYTES:
                    yield self._batch(partition.path, held)
                    held, size = [], 0
            if held:
                yield self._batch(partition.path, held)

    def _lines(self, file, partition: Part) -> Iterator[bytes]:
        if partition.kind == "binary":
            for own, pos, line in bcf.lines(file, bcf.Header.read(file), partition.begin, None if partition.end < 0 else partition.end):
                if not self.region or own == self.region[0] and self.region[1] <= pos <= self.region[2]:
                    yield line.encode()
        elif partition.kind == "header" and partition.path.endswith(".bcf"):
            yield from (line.encode() for line in bcf.Header.read(file).lines)
        elif partition.kind == "part":
            yield from bgzf.part(file, partition.begin, partition.end)
        elif partition.kind == "header":
            for _, line in bgzf.lines(file, 0):
                if not line.startswith(b"#"):
                    return
                yield line
        else:
            chrom, start, stop = self.region
            for _, line in bgzf.lines(file, partition.begin, partition.end):
                own, pos, _ = line.split(b"\t", 2)
                if own == chrom.encode() and start <= int(pos) <= stop:
                    yield line

    @staticmethod
    def _batch(path: str, held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array([x.rstrip(b"\r").decode() for x in held])], names=["path", "value"])


def block_gzipped(path: str) -> bool:
    """Whether a file is one of BGZF blocks that tasks can open themselves; other gzip files are read by one task each."""
    if not path.endswith((".gz", ".bgz", ".bcf")):
        return False
    try:
        with at_any_place(path) as file:
            return bgzf.is_bgzf(file)
    except (OSError, ValueError):
        return False


def read_lines(spark: SparkSession, paths: list[str], chrom: str | None = None, start: int | None = None, stop: int | None = None, header: bool = False, split: int = SPLIT) -> DataFrame:
    """``path, value``: the lines of block-gzipped files.

    With a region, records of it only: where ``<path>.tbi`` or ``<path>.csi`` is there, no other block is read than those that it names (one that
    names too few loses records, as with any reader of indexes); else the file is read whole. Files are
    split at block borders into tasks of ``split`` compressed bytes.
    """
    ship(spark)
    spark.dataSource.register(Lines)
    reader = spark.read.format("bgzf_lines").option("paths", "\n".join(paths)).option("split", split)
    if header:
        reader = reader.option("header", "true")
    elif chrom is not None:
        reader = reader.option("chrom", chrom).option("start", start).option("stop", stop)
    return reader.load()
