"""The same results from precomputed summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.variants import two_sided_p
from .intervals import overlaps


def covariance_rows(cov: DataFrame) -> DataFrame:
    """``(chrom, pos1, pos2, value)`` from rows with comma-separated positions and covariances.

    A covariance may hold several parts with colons between; the first counts.
    """
    pairs = F.arrays_zip(F.split("positions", ",").alias("p"), F.split("covs", ",").alias("c"))
    one = cov.select("chrom", "pos", F.explode(pairs).alias("z")).select("chrom", F.col("pos").alias("pos1"), F.col("z")["p"].try_cast("bigint").alias("pos2"), F.split(F.col("z")["c"], ":")[0].try_cast("double").alias("value"))
    return one.where(F.col("pos2").isNotNull())


def oriented(value: Column, same: Column, af1: Column, af2: Column) -> Column:
    """The sign turns off the diagonal where just one of two frequencies is over one half."""
    return F.when(~same & ((af1 > 0.5) != (af2 > 0.5)), -value).otherwise(value)


def lookup(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs of positions with their variants, and covariances oriented to the minor alleles.

    Covariance files name no alleles, so of several alleles at one position the last in the
    score file (by ``line``) stands for it. Positions that the score file lacks give no pairs (``unmatched_positions``).
    """
    last = scores.groupBy("chrom", "pos").agg(F.max_by("variant", "line").alias("variant"), F.max_by("alt_freq", "line").alias("alt_freq"))
    for i in ("1", "2"):
        pairs = pairs.join(last.select("chrom", *[F.col(c).alias(f"{c}{i}") for c in ("pos", "variant", "alt_freq")]), ["chrom", f"pos{i}"])
    v = oriented(F.col("value"), F.col("pos1") == F.col("pos2"), F.col("alt_freq1"), F.col("alt_freq2"))
    return pairs.select("chrom", "pos1", "variant1", "pos2", "variant2", v.alias("value"))


def load_region(cov: DataFrame, scores: DataFrame, chrom: str, start: int, stop: int) -> DataFrame:
    """Pairs of a region with oriented covariances; variants and frequencies are looked up by position."""
    return lookup(covariance_rows(cov).where((F.col("chrom") == chrom) & F.col("pos1").between(start, stop) & (F.col("pos2") <= stop)), scores)


def unmatched_positions(cov: DataFrame, scores: DataFrame) -> DataFrame:
    """Positions of covariances that the score file lacks: an error for the caller to report."""
    both = covariance_rows(cov).select("chrom", F.explode(F.array("pos1", "pos2")).alias("pos")).distinct()
    return both.join(scores.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_anti")


def files_overlapping(manifest: DataFrame, chrom: str, start: int, stop: int) -> DataFrame:
    """Files whose region meets the interval; region ends are ``region_start`` and ``region_mid``."""
    return manifest.where((F.col("chrom") == chrom) & (F.col("region_start") <= stop) & (F.col("region_mid") >= start))


def block_pairs(scores: DataFrame, covariances: DataFrame) -> DataFrame:
    """The manifest of score blocks, numbered in order, each with its covariance file's path and cutoff.

    A score block must meet exactly one covariance file; none or several are an error.
    """
    cov = covariances.select(F.col("path").alias("cov_path"), "chrom", F.col("region_start").alias("a"), F.col("region_mid").alias("b"), F.col("cutoff").alias("cov_cutoff"))
    here = overlaps(scores.select("path", "chrom", "region_start", "region_mid"), cov, left_bounds=("region_start", "region_mid"), right_bounds=("a", "b"))
    met = scores.drop("cutoff").join(here.select("path", "cov_path", "cov_cutoff"), "path", "left")
    several = Window.partitionBy("path")
    number = F.row_number().over(Window.partitionBy("chrom").orderBy("region_start", "path")) - 1  # a row for each file
    wrong = F.raise_error(F.concat(F.lit("a score block needs one covariance block, and has "), F.col("m").cast("string"))).cast("string")
    counted = met.withColumn("m", F.count("cov_path").over(several))
    return counted.select(*[c for c in scores.columns if c != "cutoff"], F.when(F.col("m") == 1, F.col("cov_path")).otherwise(wrong).alias("cov_path"), F.col("cov_cutoff").alias("cutoff"), number.cast("int").alias("block"))


def blocks_of_region(manifest: DataFrame, chrom: str, start: int, stop: int) -> DataFrame:
    """The numbered blocks that meet a region, and the one after them: a block's last rows reach into it.

    A chromosome or region without a block is an error.
    """
    on = manifest.where(F.col("chrom") == chrom)
    found = files_overlapping(on, chrom, start, stop).agg(F.min("block").alias("low"), F.max("block").alias("high")).first()
    if found["low"] is None:
        raise QueryError(f"no block meets {chrom}:{start}-{stop}")
    return on.where(F.col("block").between(found["low"], found["high"] + 1))


def cutoff_variants(scores: DataFrame) -> DataFrame:
    """Variants below their block's frequency cutoff, with their place in the block and over all blocks.

    ``scores(block, chrom, pos, ref, alt, maf, n, u, v, alt_ac, gtu array, cutoff)``. Blocks are joined end to
    end in order, so a block's places go on from those of the blocks before.
    """
    kept = scores.where((F.col("maf") >= 0) & (F.col("maf") < F.col("cutoff")))
    local = kept.withColumn("local", (F.row_number().over(Window.partitionBy("block").orderBy("pos", "ref", "alt")) - 1).cast("long"))
    sizes = local.groupBy("block").agg(F.count("*").alias("size"))
    # a row for each block
    offsets = sizes.select("block", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return local.join(offsets, "block").withColumn("idx", F.col("local") + F.col("offset"))


def block_scores(scores: DataFrame) -> DataFrame:
    """z, p-value and frequency from U, V and counts."""
    z = F.try_divide(F.col("u"), F.sqrt("v"))
    return scores.select("*", z.alias("z"), two_sided_p(z).alias("pvalue"), F.try_divide(F.col("alt_ac"), 2e0 * F.col("n")).alias("alt_freq"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0e0), lambda s, x: s + x)


def _block_values(pairs: DataFrame, gtg: DataFrame) -> DataFrame:
    """Of pairs with both places: what a covariance block holds for them, zero else, less the covariates' part."""
    sparse = pairs.withColumn("col", F.col("idx2") - F.col("offset")).join(gtg, ["block", "row", "col"], "left")
    return sparse.withColumn("value", (F.coalesce("gtg", F.lit(0e0)) - dot(F.col("u1"), F.col("u2"))) / F.col("n"))


def block_covariance(variants: DataFrame, gtg: DataFrame) -> DataFrame:
    """``(idx1, idx2, value)``: (GtG - GtU1 . GtU2) / N for all pairs of a block and its right neighbour's.

    ``variants``: of ``cutoff_variants``; ``gtg(block, row, col, gtg)``: sparse, by place from the block's start,
    absent ones zero.
    """
    a = variants.select("block", F.col("idx").alias("idx1"), F.col("local").alias("row"), F.col("gtu").alias("u1"), "n", "offset")
    b = variants.select(F.col("block").alias("block2"), F.col("idx").alias("idx2"), F.col("gtu").alias("u2"))
    near = a.withColumn("block2", F.explode(F.array(F.col("block"), F.col("block") + 1)))
    return _block_values(near.join(b, "block2").where("idx1 <= idx2"), gtg).select("idx1", "idx2", "value")


def load_blocks(variants: DataFrame, gtg: DataFrame, chrom: str, start: int, stop: int) -> tuple[DataFrame, DataFrame]:
    """``(scores, pairs)`` of a region from block files: all its pairs, those of distant blocks too.

    ``variants``: of ``cutoff_variants`` over the region's blocks. A block meets itself and those after it: places go on from block to block.
    """
    inside = variants.where((F.col("chrom") == chrom) & F.col("pos").between(start, stop))
    a = inside.select("chrom", "block", F.col("pos").alias("pos1"), F.col("variant").alias("variant1"), F.col("idx").alias("idx1"), F.col("local").alias("row"), F.col("gtu").alias("u1"), "offset", "n")
    b = inside.select(F.col("block").alias("block2"), F.col("pos").alias("pos2"), F.col("variant").alias("variant2"), F.col("idx").alias("idx2"), F.col("gtu").alias("u2"))
    blocks = inside.groupBy("chrom").agg(F.collect_set("block").alias("blocks"))  # a number for each block
    pairs = a.join(F.broadcast(blocks), "chrom").withColumn("block2", F.explode(F.expr("filter(blocks, x -> x >= block)"))).join(b, "block2").where("idx1 <= idx2")
    scores = block_scores(inside).withColumn("score_stat", F.col("u"))
    return scores, _block_values(pairs, gtg).select("chrom", "pos1", "variant1", "pos2", "variant2", "value")


def group_blocks(members: DataFrame, gtg: DataFrame) -> DataFrame:
    """``(group, chrom, pos1, variant1, pos2, variant2, value)`` of each group's variants (``group`` beside those of ``cutoff_variants``)."""
    a = members.select("group", "chrom", "block", F.col("pos").alias("pos1"), F.col("variant").alias("variant1"), F.col("idx").alias("idx1"), F.col("local").alias("row"), F.col("gtu").alias("u1"), "offset", "n")
    b = members.select("group", F.col("pos").alias("pos2"), F.col("variant").alias("variant2"), F.col("idx").alias("idx2"), F.col("gtu").alias("u2"))
    return _block_values(a.join(b, "group").where("idx1 <= idx2"), gtg).select("group", "chrom", "pos1", "variant1", "pos2", "variant2", "value")
