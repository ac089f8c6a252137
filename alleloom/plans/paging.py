"""Pages of results in Z-order of cells, resumable from a cursor."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.variants import morton, segment
from ..operators import ld
from ..operators.genotype import in_region
from . import zorder
from .cellstore import CellStore
from .zorder import bigmin  # noqa: F401

#: Segments (about) of a block that cells are made from.
CELL_BLOCK = 1024
PAIR_ORDER = ("cell", "pos1", "variant1", "pos2", "variant2")
VARIANT_ORDER = ("cell", "pos", "variant")
SCORE_ORDER = ("segment", "pos", "variant")


@dataclass(frozen=True)
class Cursor:
    """The place of the last row given, and the number of the next page."""

    place: tuple
    page: int = 1

    def __str__(self) -> str:
        return json.dumps([*self.place, self.page], separators=(",", ":"))

    @classmethod
    def parse(cls, text: str) -> Cursor:
        try:
            *place, page = json.loads(text)
            return cls(tuple(place), int(page))
        except (ValueError, TypeError) as e:
            raise QueryError("not a cursor", text) from e


def keyset(rows: DataFrame, order: tuple[str, ...], limit: int, after: Cursor | None = None) -> DataFrame:
    """The next ``limit`` rows after a place; a top-k, so no full sort. Pages put together are the whole result."""
    if after:
        kinds = {f.name: f.dataType for f in rows.schema}
        if len(after.place) != len(order):
            raise QueryError("the cursor is of another kind of page", str(after))
        rows = rows.where(F.struct(*order) > F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, after.place, strict=True)]))
    return rows.orderBy(*order).limit(limit)


def next_cursor(rows: list, order: tuple[str, ...], limit: int, after: Cursor | None = None) -> Cursor | None:
    """From a page's collected rows; none after the last."""
    if len(rows) < limit or not rows:
        return None
    return Cursor(tuple(rows[-1][c] for c in order), (after.page if after else 0) + 1)


def celled(pairs: DataFrame, size: int) -> DataFrame:
    """Adds the Morton code of the pair's segments."""
    return pairs.withColumn("cell", morton(segment(F.col("pos1"), size), segment(F.col("pos2"), size)))


def page(pairs: DataFrame, size: int, limit: int, after: Cursor | None = None) -> DataFrame:
    """A page of pairs that are there already."""
    return keyset(celled(pairs, size), PAIR_ORDER, limit, after)


def segments_of(calls: DataFrame, chrom: str, start: int, stop: int, size: int) -> zorder.Segments:
    """Carried variants of a region's segments; a small job for each 4096 segments that a walk comes to."""

    def read(first: int, last: int) -> dict[int, int]:
        inside = in_region(calls, chrom, max(start, first * size), min(stop, last * size + size - 1))
        carried = inside.where("dosage > 0").select("pos", "variant").distinct()
        return {r["segment"]: r["m"] for r in carried.groupBy(segment(F.col("pos"), size).alias("segment")).agg(F.count("*").alias("m")).collect()}

    return zorder.Segments(start // size, stop // size, read)


def cells_of_page(counts: dict[int, int] | zorder.Segments, limit: int, diagonal: bool = False, after: Cursor | None = None) -> list[tuple[int, int]]:
    """The cells (i <= j) in Z-order whose pairs fill the next page, from the number of variants in each segment.

    They are walked to from the cursor, and no further than the page goes: each has a pair, so there are ``limit`` of them at most
    (and the cursor's own, of whose pairs some may be left).
    """
    segments = counts if isinstance(counts, zorder.Segments) else zorder.Segments.of(counts)
    out, total, given = [], 0, after.place[0] if after else -1
    for i, j in zorder.walk(segments, given - 1):
        own = segments[i]
        pairs = own * segments[j] if i < j else own * (own - 1) // 2 + (own if diagonal else 0)
        if zorder.code(i, j) == given:
            out.append((i, j))  # how many of the cell's pairs are left isn't known
        elif pairs:
            out.append((i, j))
            total += pairs
            if total >= limit:
                break
    return out


def _of_segments(calls: DataFrame, chrom: str, segments: DataFrame, low: int, high: int, size: int) -> DataFrame:
    inside = in_region(calls, chrom, low * size, high * size + size - 1)
    return inside.join(segments, segment(F.col("pos"), size) == segments["s"], "left_semi")


def _stored_pairs(store: CellStore, named: dict, calls: DataFrame, n: int, cells: DataFrame, low: int, high: int) -> DataFrame:
    """Whole cells, from the store where it has them."""
    chrom, size = named["chrom"], named["size"]

    def compute(missing: DataFrame) -> DataFrame:
        own = _of_segments(calls, chrom, missing.select(F.explode(F.array("i", "j")).alias("s")).distinct(), low, high, size)
        return ld.region_pairs(own, n, named["metric"], True, cells=missing.withColumn("chrom", F.lit(chrom)), size=size)

    return store.pairs(cells, compute, **named)


def region_page(
    calls: DataFrame, n: int, chrom: str, start: int, stop: int, metric: str, size: int, limit: int, after: Cursor | None = None, diagonal: bool = False, store: CellStore | None = None, dataset: str = "", subset: str = "ALL", dense: bool | None = False
) -> DataFrame:
    """A page of a region's pairs, of which only those in the page's cells are formed.

    Small jobs count the variants of the segments that the walk to the page's end comes to, so what the driver holds
    grows with the page and not with the region. With a ``store`` the page's cells are computed whole and kept under the names of the ``dataset`` and
    ``subset`` of samples, the metric and the size, and read where an earlier page or region has kept them. ``dense``: multiply tiles instead of joining
    carriers; null decides by the page's share of carriers, one small job.
    """
    chosen = cells_of_page(segments_of(calls, chrom, start, stop, size), limit, diagonal, after)
    cells = calls.sparkSession.createDataFrame([(chrom, i, j) for i, j in chosen], "chrom string, i long, j long")
    used = sorted({s for c in chosen for s in c})
    if store is not None and used:
        named = {"dataset": dataset, "subset": subset, "metric": metric, "chrom": chrom, "size": size}
        pairs = _stored_pairs(store, named, calls, n, cells.select("i", "j"), used[0], used[-1])
        pairs = pairs.where(F.col("pos1").between(start, stop) & F.col("pos2").between(start, stop))
        if not diagonal:
            pairs = pairs.where("pos1 <> pos2 or variant1 <> variant2")
        return page(pairs, size, limit, after)
    inside = in_region(calls, chrom, start, stop)
    if used:
        inside = inside.where(F.col("pos").between(used[0] * size, used[-1] * size + size - 1))
    if len(used) < 100:
        inside = inside.where(segment(F.col("pos"), size).isin(used))
    else:
        inside = _of_segments(inside, chrom, cells.select(F.explode(F.array("i", "j")).alias("s")).distinct(), used[0], used[-1], size)
    if dense is None:
        dense = ld.carried_share(inside, n) >= ld.DENSE
    pairs = ld.dense_pairs if dense else ld.region_pairs
    return page(pairs(inside, n, metric, diagonal=diagonal, cells=cells, size=size), size, limit, after)


def variant_page(calls: DataFrame, n: int, index: str, chrom: str, start: int, stop: int, metric: str, size: int, limit: int, after: Cursor | None = None) -> DataFrame:
    """A page of one variant against a region, by cell, position and name.

    A cell's place grows with the other segment, so the order is that of positions: the page is computed from the cursor's
    position up to the segment in which it is full, and no other part of the region is.
    """
    if after and len(after.place) == len(VARIANT_ORDER):
        start = max(start, int(after.place[1]))
    if stop > start:
        segments = segments_of(calls, chrom, start + 1, stop, size)  # the cursor's own position may have been given
        stop = min(stop, segments.until(limit) * size + size - 1)
    rows = ld.variant(calls, n, index, chrom, start, stop, metric)
    own, other = segment(F.col("index_pos"), size), segment(F.col("pos"), size)
    return keyset(rows.withColumn("cell", morton(F.least(own, other), F.greatest(own, other))), VARIANT_ORDER, limit, after)


def score_page(scores: DataFrame, size: int, limit: int, after: Cursor | None = None) -> DataFrame:
    """A page of score statistics, by segment, position and name."""
    return keyset(scores.withColumn("segment", segment(F.col("pos"), size)), SCORE_ORDER, limit, after)


def allowed_cells(positions: DataFrame, size: int) -> DataFrame:
    """Cells (i <= j) between segments that have listed positions; one row for each.

    A chromosome's segments are dealt into blocks, and a segment meets each block in a row that the block's cells are made from.
    """
    seg = positions.select("chrom", segment(F.col("pos"), size).alias("i")).distinct()
    sizes = seg.groupBy("chrom").agg(F.ceil(F.count("*") / F.lit(CELL_BLOCK)).cast("int").alias("blocks"))
    counted = seg.join(sizes, "chrom")
    blocks = counted.groupBy("chrom", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list("i").alias("all"))
    each = counted.select("chrom", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # a number of partitions of its own: sizes of rows say nothing of the cells that they make
    each = each.repartition(int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom", "block")
    cells = each.join(blocks, ["chrom", "block"]).select("chrom", "i", F.explode("all").alias("j")).where("i <= j")
    return cells.withColumn("cell", morton(F.col("i"), F.col("j")))
