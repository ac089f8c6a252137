"""Pairs kept by the cell of the Z-order curve: regions that overlap share cells, and only cells that nobody has stored are computed.

Under a result's folder are batches of pairs, written first, and a manifest for each that lists the batch's cells. A manifest
is written beside and then renamed, so a batch counts wholly or not at all; where two writers stored a cell, one batch is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variants import morton, segment
from .cache import key

#: What tells results apart; cells are of segments of one size, whatever the region that asked for them.
NAMES = ("dataset", "subset", "metric", "chrom", "size")
PAIRS = "i long, j long, pos1 long, variant1 string, pos2 long, variant2 string, value double, cell long"
CELLS = "i long, j long, batch string"


@dataclass(frozen=True)
class CellStore:
    """Cells in a folder that driver and executors share."""

    spark: SparkSession
    root: str

    def _folder(self, named: dict) -> str:
        return f"{self.root}/{key(NAMES, **named)}"

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def stored(self, **named) -> DataFrame:
        """``i, j, batch``: cells of a result that are stored, each with one batch."""
        store, at = self._files(f"{self._folder(named)}/manifest")
        listed = [str(f.getPath()) for f in store.listStatus(at)] if store.exists(at) else []
        if not listed:
            return self.spark.createDataFrame([], CELLS)
        return self.spark.read.schema(CELLS).parquet(*listed).groupBy("i", "j").agg(F.min("batch").alias("batch"))

    def _publish(self, folder: str, batch: str, cells: DataFrame) -> None:
        cells.select("i", "j", F.lit(batch).alias("batch")).coalesce(1).write.parquet(f"{folder}/writing/{batch}")
        store, to = self._files(f"{folder}/manifest/{batch}")
        store.mkdirs(to.getParent())
        if not store.rename(self._files(f"{folder}/writing/{batch}")[1], to):
            raise OSError(f"{to} could not be published")

    def pairs(self, cells: DataFrame, compute: Callable[[DataFrame], DataFrame], **named) -> DataFrame:
        """``chrom, pos1, variant1, pos2, variant2, value`` of the pairs of ``cells(i, j)``, a page's or a region's.

        ``compute`` gets the cells that are missing, none twice, and gives all their pairs, the diagonal ones too; cells without pairs are
        stored as such. What is stored already is read by the cells' places.
        """
        folder, wanted = self._folder(named), cells.select("i", "j").distinct()
        missing = wanted.join(self.stored(**named).select("i", "j"), ["i", "j"], "left_anti")
        if missing.limit(1).count():
            batch, size = uuid.uuid4().hex, int(named["size"])
            rows = compute(missing).select(segment(F.col("pos1"), size).alias("i"), segment(F.col("pos2"), size).alias("j"), "pos1", "variant1", "pos2", "variant2", "value")
            rows = rows.withColumn("cell", morton(F.col("i"), F.col("j")))
            rows.repartitionByRange("cell", "pos1").sortWithinPartitions("cell", "pos1", "variant1", "pos2", "variant2").write.option("compression", "zstd").parquet(f"{folder}/pairs/{batch}")
            self._publish(folder, batch, missing)
        held = self.stored(**named).join(wanted, ["i", "j"], "left_semi")
        used = held.groupBy("batch").agg(F.min(morton(F.col("i"), F.col("j"))).alias("low"), F.max(morton(F.col("i"), F.col("j"))).alias("high")).collect()  # a row for each batch
        out = self.spark.createDataFrame([], f"{PAIRS}, batch string")
        for r in used:
            part = self.spark.read.schema(PAIRS).parquet(f"{folder}/pairs/{r['batch']}").where(F.col("cell").between(r["low"], r["high"]))
            out = out.unionByName(part.withColumn("batch", F.lit(r["batch"])))
        return out.join(held, ["i", "j", "batch"], "left_semi").select(F.lit(named["chrom"]).alias("chrom"), "pos1", "variant1", "pos2", "variant2", "value")
