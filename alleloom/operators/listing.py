"""Variant listings for any kind of dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from .genotype import in_region


def list_variants(rows: DataFrame, kind: str, chrom: str, start: int, stop: int) -> DataFrame:
    """``kind``: genotype (all listed, carried or not), scores, or blocks (only below their cutoff)."""
    rows = in_region(rows, chrom, start, stop)
    if kind == "blocks":
        rows = rows.where((F.col("maf") >= 0) & (F.col("maf") < F.col("cutoff")))
    elif kind not in ("genotype", "scores"):
        raise QueryError(f"unknown dataset kind {kind}")
    return rows.select("chrom", "pos", "variant").distinct()
