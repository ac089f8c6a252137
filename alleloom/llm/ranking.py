"""Gapless ranks within very large groups, without one task for a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places on the circle of hashes: three hex digits of an id's MD5.
SLOTS = 4096
#: Copies of one row are handed out in chunks of so many.
CHUNK = 1 << 16


def ring_key(id_col: str = "doc_id"):
    """The MD5 of the id as text, and the place of its first three digits; null ids hash like the empty text."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return digest, F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def ranked(rows: DataFrame, groups: Sequence[str], part: str, order: Sequence[str], step: int = 64) -> DataFrame:
    """Adds ``rank`` (from 0) within ``groups`` by ``part``, then ``order``; a row stands for its ``copies``, whose first rank it gets.

    ``part`` numbers a group's parts from 0. Each is ranked by itself, and the parts' sums are added up in runs of
    ``step`` parts, then the runs' sums: a task holds one part, or ``step`` numbers, or one for each run of a group.
    """
    keys, run = [*groups, part], F.floor(F.col(part) / F.lit(step)).alias("run")

    def before(by: list[str], order: list[str], n: str):
        return F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = rows.groupBy(*keys).agg(F.sum("copies").alias("n")).select(*keys, "n", run)
    runs = sums.groupBy(*groups, "run").agg(F.sum("n").alias("n")).select(*groups, "run", before([*groups], ["run"], "n").alias("earlier"))
    sums = sums.withColumn("before", before([*groups, "run"], [part], "n")).join(runs, [*groups, "run"])
    sums = sums.select(*keys, (F.col("before") + F.col("earlier")).alias("before"))
    own = rows.withColumn("own", before(keys, [*order], "copies"))
    return own.join(sums, keys).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before")


def each_copy(rows: DataFrame) -> DataFrame:
    """A row for each of the ``copies``, with its own rank. Many copies of one row are dealt over the cluster before they become rows."""
    few, many = rows.where(F.col("copies") <= CHUNK), rows.where(F.col("copies") > CHUNK)
    chunks = many.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(CHUNK).cast("bigint"))))
    chunks = chunks.withColumn("rank", F.col("rank") + F.col("first")).withColumn("copies", F.least(F.lit(CHUNK).cast("bigint"), F.col("copies") - F.col("first"))).drop("first")
    every = few.unionByName(chunks.repartition("rank"))
    return every.withColumn("rank", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("copies") - 1))).drop("copies")
