"""Genotype calls as sparse rows: one for each carried or missing allele count.

``calls(chrom, pos, variant, sample, dosage)``; a null dosage is a missing call, no row is zero.
Calls of haplotypes also have ``hap``, the number of a sample's haplotype, and count 1 each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the segments that calls are stored by.
STORED = 1_000_000


def unit(calls: DataFrame) -> list[str]:
    """The columns that name a row of the genotype matrix: a haplotype's or a sample's."""
    return ["sample", "hap"] if "hap" in calls.columns else ["sample"]


def size(samples: DataFrame, haplotypes: bool = False, ploidy: int = 2) -> int:
    """Number of samples, or of their haplotypes."""
    return samples.select("sample").distinct().count() * (ploidy if haplotypes else 1)


def as_samples(haplotypes: DataFrame) -> DataFrame:
    """Allele counts of samples from haplotypes; a sample with a missing haplotype is missing."""
    g = F.when(F.count_if(F.col("dosage").isNull()) == 0, F.sum("dosage"))
    return haplotypes.groupBy("chrom", "pos", "variant", "sample").agg(g.alias("dosage"))


def chromosomes(calls: DataFrame) -> DataFrame:
    """``(chrom)``: one row for each; of a stored table only the folder names are read."""
    return calls.select("chrom").distinct()


def in_region(rows: DataFrame, chrom: str, start: int, stop: int) -> DataFrame:
    """Rows between the bounds, both included; reaches the Parquet scan as a pushed filter.

    Of calls stored by ``write_calls`` only the region's folders are read.
    """
    rows = rows.where((F.col("chrom") == chrom) & F.col("pos").between(start, stop))
    if "segment" in rows.columns:
        rows = rows.where(F.col("segment").between(start // STORED, stop // STORED))
    return rows


def of_samples(calls: DataFrame, samples: DataFrame | None) -> DataFrame:
    """Calls of a sample subset; null for all."""
    return calls if samples is None else calls.join(samples.select("sample").distinct(), "sample", "left_semi")


def frequencies(calls: DataFrame, n_samples: int) -> DataFrame:
    """Allele count, missing calls, mean over all samples and frequency; variants that nobody carries are left out."""
    sums = calls.groupBy("chrom", "pos", "variant").agg(
        F.sum("dosage").alias("ac"), F.sum("dosage").alias("s"), F.sum(F.col("dosage") * F.col("dosage")).alias("ss"), F.sum(F.col("dosage").isNull().cast("long")).alias("n_missing")
    )
    n = F.lit(float(n_samples))
    return sums.where("ac > 0").select("chrom", "pos", "variant", "ac", "ss", "n_missing", (F.col("ac") / n).alias("mean"), (F.col("ac") / (2 * n)).alias("af"))


def polymorphic(calls: DataFrame) -> DataFrame:
    """Calls of variants that someone carries: whether one is kept depends on the samples chosen."""
    carried = calls.where("dosage > 0").select("chrom", "pos", "variant").distinct()
    return calls.join(carried, ["chrom", "pos", "variant"], "left_semi")


def variants(calls: DataFrame) -> DataFrame:
    """All variants listed in the calls, whether or not anyone carries them."""
    return calls.select("chrom", "pos", "variant").distinct()
