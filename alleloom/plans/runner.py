"""Scores and covariances of groups of variants: from genotypes and a phenotype, or from precomputed statistics."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.variants import minor
from ..operators import score, sumstats
from ..operators.genotype import of_samples

GROUP = ("mask", "group")


@dataclass(frozen=True)
class Answer:
    """What a request about groups gives.

    ``variants``: each once; ``members``: the scores of each group's variants; ``pairs``: each group's upper triangle
    with diagonal, in units of the residual variance; ``groups``: their mean minor frequencies. Groups without a
    variant that passed are in none.
    """

    variants: DataFrame
    members: DataFrame
    pairs: DataFrame
    groups: DataFrame
    sigma2: float | None
    nsamples: int | None


def masked(masks: list[tuple[str, DataFrame]]) -> DataFrame:
    """The groups of several masks, in the order of the masks."""
    rows = None
    for place, (name, groups) in enumerate(masks):
        one = groups.select(F.lit(name).alias("mask"), F.lit(place).alias("mask_place"), "group", "chrom", "pos", "variant").distinct()
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise QueryError("no mask")
    return rows


def _stored(rows: DataFrame, root: str | None, name: str) -> DataFrame:
    """The rows as a table under a shared folder, if one is given."""
    if root is None:
        return rows
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _answer(scores: DataFrame, groups: DataFrame, filters: list[dict], pairs_of, sigma2: float | None, nsamples: int | None, root: str | None = None) -> Answer:
    """``pairs_of``: from groups of surviving variants (``group`` as one key) to pairs."""
    key = F.to_json(F.struct(*GROUP))
    members = _stored(score.filtered(scores.join(groups, ["chrom", "pos", "variant"]), filters).withColumn("key", key), root, "members")
    pairs = pairs_of(members.select(F.col("key").alias("group"), "chrom", "pos", "variant").distinct())
    names = members.select("key", *GROUP, "mask_place").distinct()
    pairs = pairs.withColumnRenamed("group", "key").join(names, "key").drop("key")
    means = members.groupBy(*GROUP, "mask_place").agg(F.avg(minor(F.col("alt_freq"))).alias("mean_minor_freq"), F.count("*").alias("n_variants"))
    return Answer(score.response_variants(members), members.drop("key"), pairs, means, sigma2, nsamples)


def compute(calls: DataFrame, samples: DataFrame, phenotype: DataFrame, groups: DataFrame, filters: list[dict] | None = None, subset: DataFrame | None = None, root: str | None = None) -> Answer:
    """From counts of ``samples`` and ``phenotype(sample, y)``; ``groups`` of ``masked``.

    Only samples count that the genotypes hold, that have a finite phenotype and that are of the subset; variants that
    none of them carries fall out. Scores and covariances are over the same samples. One small job takes their number
    and the phenotype's variance. Each part of the answer is computed when it is used; with ``root``, a folder that executors share, the samples, the
    groups' calls and the surviving variants are written there first, so that each file is read once, however many parts are used.
    """
    have = score.complete(of_samples(phenotype, samples)).dropDuplicates(["sample"])
    have = _stored(of_samples(have, subset), root, "samples")
    groups = _stored(groups, root, "groups")
    m = score.moments(have).first()
    if not m["nsamples"]:
        raise QueryError("no sample has both genotypes and a phenotype")
    own = of_samples(calls.join(groups.select("chrom", "pos", "variant").distinct(), ["chrom", "pos", "variant"], "left_semi"), have)
    own = _stored(own, root, "calls")
    return _answer(score.score_statistics(own, have), groups, filters or [], lambda g: score.group_covariance(own, g, m["nsamples"], m["sigma2"]), m["sigma2"], m["nsamples"], root)


def _within(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of precomputed covariances that lie within a group, from the variant that comes first."""
    for i in ("1", "2"):
        side = groups.select("group", "chrom", F.col("pos").alias(f"pos{i}"), F.col("variant").alias(f"variant{i}"))
        pairs = pairs.join(side, [*(["group"] if i == "2" else []), "chrom", f"pos{i}", f"variant{i}"])
    return pairs.select("group", "chrom", "pos1", "variant1", "pos2", "variant2", "value")


def precomputed(scores: DataFrame, cov: DataFrame, groups: DataFrame, filters: list[dict] | None = None, sigma2: float | None = None, nsamples: int | None = None) -> Answer:
    """From score and covariance files (``files.read_scores``, ``read_covariances``); covariances are scaled already."""
    last = scores.groupBy("chrom", "pos").agg(F.max_by(F.struct("variant", "alt_freq", "score_stat", "pvalue"), "line").alias("v")).select("chrom", "pos", "v.*")
    pairs = sumstats.lookup(sumstats.covariance_rows(cov), scores)
    return _answer(last, groups, filters or [], lambda g: _within(pairs, g), sigma2, nsamples)


def precomputed_blocks(blocks: DataFrame, gtg: DataFrame, groups: DataFrame, filters: list[dict] | None = None) -> Answer:
    """From block files (``files.read_blocks`` with a manifest, ``read_block_covariances``), which name no residual variance."""
    variants = sumstats.cutoff_variants(blocks)
    scores = sumstats.block_scores(variants).select("chrom", "pos", "variant", "alt_freq", F.col("u").alias("score_stat"), "pvalue")
    n = blocks.agg(F.max("n").alias("n")).first()["n"]

    def pairs_of(g: DataFrame) -> DataFrame:
        return sumstats.group_blocks(variants.join(g, ["chrom", "pos", "variant"]), gtg)

    return _answer(scores, groups, filters or [], pairs_of, None, int(n) if n is not None else None)
