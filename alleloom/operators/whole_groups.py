"""Pairs of small groups: a task takes many whole groups at once, sorted by group, and adds up the products of their entries by places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: A group of so many rows of calls and so many entries at most is taken whole; others are dealt into blocks.
MEMBERS, ENTRIES = 512, 1 << 18
#: Groups are taken together up to so many entries, and pairs are given out by so many.
TOGETHER, PAIRS = 1 << 19, 1 << 16
NAMES = ("group", "chrom", "pos", "variant")


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy()
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def _begins(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Where a row differs from the one before, the first row included."""
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def products(rows: pa.Table, keys: list[str], diagonal: bool) -> Iterator[pa.RecordBatch]:
    """All pairs of whole groups, ``group, chrom, pos1, variant1, s1, pos2, variant2, s2, s12``; the rows are in order of group, chromosome, position and name."""
    n = rows.num_rows
    names = [_codes(rows[c]) for c in NAMES]
    variant = np.cumsum(_begins(names, n)) - 1  # a variant of many entries has several rows
    at = np.flatnonzero(np.diff(variant, prepend=-1))
    first = _begins([c[at] for c in names[:2]], len(at))
    group = np.cumsum(first) - 1
    stops = np.append(np.flatnonzero(first)[1:], len(at))
    count = stops[group] - np.arange(len(at)) - (0 if diagonal else 1)  # partners of each variant, those after it in its group
    begin = np.cumsum(count) - count

    x = rows["x"].combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(rows["sample"]).to_numpy()
    own = np.repeat(variant, sizes)
    samples = [_codes(pa.chunked_array([rows[k].combine_chunks().flatten()])) for k in keys]
    order = np.lexsort((own, *samples, group[own]))
    own, x, samples = own[order], x[order], [k[order] for k in samples]
    alike = np.cumsum(_begins([group[own], *samples], len(own)))
    s12 = np.zeros(int(count.sum()))
    # entries of one sample in one group lie side by side: those ``apart`` places from each other, until no sample has so many
    left = np.arange(len(own))
    apart = 0 if diagonal else 1
    while len(left):
        left = left[left + apart < len(own)]
        left = left[alike[left] == alike[left + apart]]
        a, b = own[left], own[left + apart]
        np.add.at(s12, begin[a] + b - a - (0 if diagonal else 1), x[left] * x[left + apart])
        apart += 1

    held = rows.select([*NAMES, "s"]).take(pa.array(np.flatnonzero(np.diff(variant, prepend=-1)))).combine_chunks()
    for low in range(0, len(s12), PAIRS):
        place = np.arange(low, min(low + PAIRS, len(s12)))
        i = np.searchsorted(begin + count, place, side="right")
        j = i + place - begin[i] + (0 if diagonal else 1)
        a, b = held.take(pa.array(i)), held.take(pa.array(j))
        out = [a["group"], a["chrom"], a["pos"], a["variant"], a["s"], b["pos"], b["variant"], b["s"], pa.array(s12[place])]
        yield from pa.Table.from_arrays(out, names=["group", "chrom", "pos1", "variant1", "s1", "pos2", "variant2", "s2", "s12"]).combine_chunks().to_batches()


def whole(batches: Iterator[pa.RecordBatch], keys: list[str], diagonal: bool) -> Iterator[pa.RecordBatch]:
    """``products`` of a partition's groups, some together; the last group of a batch waits for its other rows."""
    held: list[pa.Table] = []
    entries = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        entries += pc.sum(pc.list_value_length(batch["sample"])).as_py() or 0
        if entries >= TOGETHER:
            rows = pa.concat_tables(held)
            last = _begins([_codes(rows[c]) for c in NAMES[:2]], rows.num_rows).nonzero()[0][-1]
            if last:
                yield from products(rows.slice(0, last), keys, diagonal)
            held = [rows.slice(last)]
            entries = pc.sum(pc.list_value_length(held[0]["sample"])).as_py() or 0
    if held:
        yield from products(pa.concat_tables(held), keys, diagonal)


def whole_pairs(members: DataFrame, keys: list[str], metric: str, diagonal: bool) -> DataFrame:
    """``(group, chrom, pos1, variant1, s1, pos2, variant2, s2, s12)`` of ``members(group, chrom, pos, variant, s, fill, g)``, by whole groups."""
    ship(members.sparkSession)
    x = F.transform("g", lambda e: F.coalesce(e["dosage"], "fill") if metric == "cov" else F.lit(1e0))
    rows = members.select(*NAMES, F.col("s").cast("double").alias("s"), *[F.col("g")[k].alias(k) for k in keys], x.cast("array<double>").alias("x"))
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    schema = f"`group` {kinds['group']}, chrom {kinds['chrom']}, pos1 {kinds['pos']}, variant1 string, s1 double, pos2 {kinds['pos']}, variant2 string, s2 double, s12 double"
    return rows.repartition("group", "chrom").sortWithinPartitions(*NAMES).mapInArrow(lambda batches: whole(batches, keys, diagonal), schema)
