"""Haplotypes packed into 64-bit words: a pair's shared carriers are counted by ``bit_count(a & b)``, inside generated code.

A row holds ``WORDS`` words of one variant, so none grows with the cohort; words without a bit are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from .ld import VARIANT, _order, _valued, paired

METRICS = ("r", "rsquare", "rsquare_approx", "dprime")
WORDS = 8
CHUNK = 64 * WORDS
#: Haplotypes are numbered within buckets of about so many.
BUCKET = 16 * CHUNK
_NAMES = [f"w{k}" for k in range(WORDS)]


def numbered(samples: DataFrame, n: int, ploidy: int = 2) -> DataFrame:
    """``sample, hap, chunk, word, bit``: the place of each of the ``n`` haplotypes.

    Samples are dealt into buckets by hash and numbered within them, so no task orders the cohort. Store it beside
    a dataset to pack many regions.
    """
    bucket = F.pmod(F.xxhash64("sample"), F.lit(max(1, n // BUCKET)))
    own = samples.select("sample").distinct().withColumn("bucket", bucket).withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("sample")) - 1)
    each = own.select("sample", "bucket", "place", F.explode(F.sequence(F.lit(0), F.lit(ploidy - 1))).alias("hap")).withColumn("place", F.col("place") * ploidy + F.col("hap"))
    at = F.col("place") % CHUNK
    chunk = F.shiftleft("bucket", 32) + F.floor(F.col("place") / CHUNK)
    return each.select("sample", "hap", chunk.alias("chunk"), F.floor(at / 64).cast("int").alias("word"), (at % 64).cast("int").alias("bit"))


def packed(calls: DataFrame, places: DataFrame) -> DataFrame:
    """``chrom, pos, variant, chunk, w0 ... w7`` of variants that someone carries; a missing haplotype counts as a carrier.

    ``calls`` of haplotypes (``sample, hap``), ``places`` as of ``numbered``; haplotypes without a place are left out.
    """
    if "hap" not in calls.columns:
        raise QueryError("bits are of haplotypes")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    rows = calls.select(*VARIANT, "sample", F.col("hap").cast("int").alias("hap"), "dosage").join(places, ["sample", "hap"])
    words = [F.coalesce(F.bit_or(F.when(F.col("word") == k, one)), F.lit(0).cast("long")).alias(name) for k, name in enumerate(_NAMES)]
    chunks = rows.groupBy(*VARIANT, "chunk").agg(*words, F.count_if(F.col("dosage") > 0).alias("carried"))
    some = chunks.groupBy(*VARIANT).agg(F.sum("carried").alias("ac")).where("ac > 0").select(*VARIANT)
    return chunks.drop("carried").join(some, list(VARIANT), "left_semi")


def _bits(words: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(w) for w in words])


def sums(bits: DataFrame) -> DataFrame:
    """``chrom, pos, variant, s``: haplotypes that carry a variant."""
    return bits.groupBy(*VARIANT).agg(F.sum(_bits([F.col(w) for w in _NAMES])).cast("double").alias("s"))


def products(bits: DataFrame, diagonal: bool) -> DataFrame:
    """Shared carriers of the pairs that have a chunk in common."""

    def side(k: int) -> DataFrame:
        return bits.select("chrom", "chunk", F.col("pos").alias(f"pos{k}"), F.col("variant").alias(f"variant{k}"), *[F.col(w).alias(f"{w}_{k}") for w in _NAMES])

    both = side(1).join(side(2), ["chrom", "chunk"]).where(_order(diagonal))
    shared = _bits([F.col(f"{w}_1").bitwiseAND(F.col(f"{w}_2")) for w in _NAMES])
    return both.groupBy("chrom", "pos1", "variant1", "pos2", "variant2").agg(F.sum(shared).cast("double").alias("s12"))


def region_pairs(bits: DataFrame, n: int, metric: str = "rsquare_approx", diagonal: bool = False) -> DataFrame:
    """The rows of ``ld.region_pairs`` for haplotypes, from ``packed`` ones; ``n`` haplotypes."""
    if metric not in METRICS:
        raise QueryError(f"{metric} isn't a metric of haplotypes")
    return _valued(paired(sums(bits), diagonal), products(bits, diagonal), metric, n)
