"""Results kept as Parquet tables, so that a repeated request reads instead of computing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variants import morton, segment

#: What tells results apart; cells, segments and scores have these names in their folders' paths, in this order.
CELLS = ("dataset", "subset", "metric", "chrom", "start", "stop", "size")
SEGMENTS = ("dataset", "subset", "chrom", "start", "stop")
SCORES = (*SEGMENTS, "phenotypes", "phenotype")


def key(names: tuple[str, ...], **values) -> str:
    """The folder of a result; every name needs its value, and names that differ give different folders."""
    if set(values) != set(names):
        raise ValueError(f"a key needs {', '.join(names)}")
    quoted = {n: "".join(c if c.isalnum() or c in "-." else f"%{ord(c):04x}" for c in str(values[n])) for n in names}
    return "/".join(f"{n}={v}" for n, v in quoted.items())


def kept(spark: SparkSession, root: str, folder: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """What is stored under a key; computed and stored first if nothing is, or if an earlier run did not commit."""
    path = f"{root}/{folder}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # no such path, or nothing committed in it
        compute().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def kept_cells(spark: SparkSession, root: str, size: int, compute: Callable[[], DataFrame], **values) -> DataFrame:
    """Pairs of a region sorted by their cells: a page reads the row groups of its cells only."""

    def cells() -> DataFrame:
        pairs = compute().withColumn("cell", morton(segment(F.col("pos1"), size), segment(F.col("pos2"), size)))
        return pairs.repartitionByRange("cell", "pos1").sortWithinPartitions("cell", "pos1", "variant1", "pos2", "variant2")

    return kept(spark, root, key(CELLS, size=size, **values), cells)
