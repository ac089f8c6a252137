"""Joins of intervals by bins of several widths: equi-joins whatever the intervals' lengths, never a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bins' widths, finest first: 1 kb, 8 kb, 64 kb, ... 256 Mb, and one for all that is longer.
LEVELS = (10, 13, 16, 19, 22, 25, 28, 62)
#: Parts that the shorter intervals of a bin of each level are dealt into; longer ones go to every part, so no task has a wide bin to itself.
PARTS = (1, 1, 2, 8, 32, 64, 64, 64)


def _own(start: Column, stop: Column) -> Column:
    """The finest level whose bins are as wide as the interval: it lies in two of them at most."""
    out = F.lit(len(LEVELS) - 1)
    for level in range(len(LEVELS) - 2, -1, -1):
        out = F.when(stop - start < F.lit(1 << LEVELS[level]), F.lit(level)).otherwise(out)
    return out


def _own_levels(rows: DataFrame, on: str, start: str, stop: str) -> DataFrame:
    """The levels that intervals have as their own: a row for each chromosome."""
    return F.broadcast(rows.select(on, _own(F.col(start), F.col(stop)).alias("l")).groupBy(on).agg(F.collect_set("l").alias("_there")))


def _bins(rows: DataFrame, on: str, start: str, stop: str, levels: str, other: DataFrame) -> DataFrame:
    """A row for each bin of an interval: at its own level, at all coarser ones too (``every``), or at coarser ones only.

    At its own level it goes to each of the bin's parts, else to one of them, and only to levels that the ``other`` side has as its own.
    """
    rows = rows.withColumn("_own", _own(F.col(start), F.col(stop)))
    first = {"own": F.col("_own"), "every": F.col("_own"), "coarser": F.col("_own") + 1}[levels]
    last = F.col("_own") if levels == "own" else F.lit(len(LEVELS) - 1)
    at = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    of_level = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_level") + 1)
    bits, parts = of_level(LEVELS), of_level(PARTS)
    shift = lambda c: F.call_function("shiftright", F.col(c).cast("long"), bits)
    if levels == "own":
        rows = rows.withColumn("_level", F.explode(at)).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    else:
        rows = rows.join(other, on).withColumn("_level", F.explode(F.array_intersect(at, "_there"))).drop("_there")
        rows = rows.withColumn("_part", F.pmod(F.xxhash64(start, stop), parts).cast("int"))
    return rows.withColumn("_bin", F.explode(F.sequence(shift(start), shift(stop)))).withColumn("_bits", bits).drop("_own")


def overlaps(left: DataFrame, right: DataFrame, on: str = "chrom", left_bounds: tuple[str, str] = ("start", "stop"), right_bounds: tuple[str, str] = ("pos", "pos")) -> DataFrame:
    """Rows of both sides whose intervals (both ends included) meet, once for each pair; other columns must have different names.

    An interval is put into the bins of its own level, two at most, and into every part of these. Two intervals meet in a bin of the coarser one's level: the side whose own
    level it is has two rows in each part there, the other a row or two in one part of a bin, for each coarser level that the first side has. Of several common bins the first keeps the match.
    An interval that ends before it begins, or has a null, meets nothing; repeated rows meet each.
    """
    a0, a1 = left_bounds
    b0, b1 = right_bounds
    left = left.where(F.col(a0) <= F.col(a1))
    right = right.where(F.col(b0) <= F.col(b1))
    keys = [on, "_level", "_bin", "_part"]
    left_levels, right_levels = _own_levels(left, on, a0, a1), _own_levels(right, on, b0, b1)

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        # a number of partitions of its own: few rows may have many matches, so their sizes say nothing of the work
        a, b = (x.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) for x in (a, b))
        both = a.join(b.drop("_bits"), keys)
        first = F.call_function("shiftright", F.greatest(F.col(a0), F.col(b0)).cast("long"), F.col("_bits")) == F.col("_bin")
        return both.where((F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)) & first).select(*left.columns, *[c for c in right.columns if c != on])

    # the left one coarser or of the same level, then the right one coarser
    one = met(_bins(left, on, a0, a1, "own", right_levels), _bins(right, on, b0, b1, "every", left_levels))
    return one.unionByName(met(_bins(left, on, a0, a1, "coarser", right_levels), _bins(right, on, b0, b1, "own", left_levels)))
