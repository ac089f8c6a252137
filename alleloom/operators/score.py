"""Score statistics of variants against a phenotype, with covariances for groups of variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.variants import minor, two_sided_p
from .ld import region_pairs


def complete(phenotype: DataFrame, column: str = "y") -> DataFrame:
    """Samples with a finite phenotype."""
    return phenotype.where(F.col(column).isNotNull() & ~F.isnan(column))


def aligned(samples: DataFrame, phenotype: DataFrame) -> DataFrame:
    """The genotype's samples with their phenotype; null for samples that the phenotype lacks."""
    return samples.select("sample").distinct().join(phenotype.dropDuplicates(["sample"]), "sample", "left")


def moments(phenotype: DataFrame, column: str = "y") -> DataFrame:
    """One row: samples with a value, their mean and population variance."""
    return complete(phenotype, column).agg(F.count("*").alias("nsamples"), F.avg(column).alias("mean"), F.var_pop(column).alias("sigma2"))


def score_statistics(calls: DataFrame, phenotype: DataFrame) -> DataFrame:
    """``(chrom, pos, variant, alt_freq, score_stat, pvalue)`` over the samples with a phenotype.

    Calls are centred at the mean over all samples, missing ones are set to it. u is the sum of
    centred counts times centred phenotypes, V the sum of squared centred counts times the phenotype's
    variance; both come from sums over carriers and missing calls only. u / sqrt(V) is the test,
    u / variance the reported score. A constant phenotype gives null.
    """
    have = complete(phenotype)
    m = F.broadcast(moments(have))  # one row
    rows = calls.join(have.select("sample", "y"), "sample").join(m)
    d = F.col("y") - F.col("mean")
    g = F.col("dosage")
    sums = rows.groupBy("chrom", "pos", "variant", "nsamples", "sigma2").agg(
        F.sum(g).alias("s"), F.sum(g * g).alias("ss"), F.sum(g.isNull().cast("double")).alias("missing"), F.sum(g * d).alias("carried"), F.coalesce(F.sum(F.when(g.isNull(), d)), F.lit(0e0)).alias("absent")
    )
    sums = sums.where("s > 0")  # someone with a phenotype carries it
    n, s = F.col("nsamples").cast("double"), F.col("s").cast("double")
    u = F.col("carried") + s / n * F.col("absent")
    v = (F.col("ss") - 2 * (s / n) * s + (n - F.col("missing")) * (s / n) * (s / n)) * F.col("sigma2")
    return sums.select("chrom", "pos", "variant", (s / (2 * n)).alias("alt_freq"), F.try_divide(u, F.col("sigma2")).alias("score_stat"), two_sided_p(F.try_divide(u, F.sqrt(v))).alias("pvalue"))


def legacy_score(calls: DataFrame, phenotype: DataFrame) -> DataFrame:
    """Older form: u sums centred counts times raw phenotypes, and the test divides by the phenotype's deviation only."""
    have = complete(phenotype)
    total = F.broadcast(have.agg(F.count("*").alias("n"), F.sum("y").alias("sum_y"), F.var_pop("y").alias("sigma2")))  # one row
    # a missing call counts as the mean, so its centred value is zero
    sums = calls.join(have.select("sample", "y"), "sample").groupBy("chrom", "pos", "variant").agg(F.sum("dosage").alias("s"), F.sum(F.col("dosage") * F.col("y")).alias("gy"), F.coalesce(F.sum(F.when(F.col("dosage").isNull(), F.col("y"))), F.lit(0e0)).alias("absent_y")).where("s > 0")
    u = F.col("gy") - F.col("s") / F.col("n") * (F.col("sum_y") - F.col("absent_y"))
    return sums.join(total).select("chrom", "pos", "variant", u.alias("score_stat"), F.col("sigma2"), two_sided_p(F.try_divide(u, F.sqrt("sigma2"))).alias("pvalue"))


def group_covariance(calls: DataFrame, groups: DataFrame, n: int, sigma2: float | None = None) -> DataFrame:
    """Upper triangle with diagonal within each group; divided by the phenotype's variance if given.

    ``groups(group, chrom, pos, variant)``; the calls are those of the samples that ``n`` counts.
    """
    pairs = region_pairs(calls, n, "cov", True, groups)
    return pairs if sigma2 is None else pairs.withColumn("value", F.try_divide(F.col("value"), F.lit(float(sigma2))))


def group_minor_frequency(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean minor allele frequency of each group's variants."""
    return scores.join(groups, ["chrom", "pos", "variant"]).groupBy("group").agg(F.avg(minor(F.col("alt_freq"))).alias("mean_minor_freq"), F.count("*").alias("n_variants"))


def filtered(scores: DataFrame, filters: list[dict]) -> DataFrame:
    """Rows that pass all of ``[{"field": "maf"|"pvalue", "op": "gte"|"lte", "value": x}]``; unknown ones are an error, NaN and null never pass."""
    for f in filters:
        field = {"maf": minor(F.col("alt_freq")), "pvalue": F.col("pvalue")}.get(f.get("field"))
        if field is None or f.get("op") not in ("gte", "lte"):
            raise QueryError(f"unsupported filter {f}")
        scores = scores.where(~F.isnan(field) & (field >= f["value"] if f["op"] == "gte" else field <= f["value"]))
    return scores


def surviving_groups(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """Members that are among the scores, within their group where both have one: pairs of these alone are those of ``surviving_pairs``."""
    keys = [*(["group"] if "group" in scores.columns else []), "chrom", "pos", "variant"]
    return groups.join(scores.select(*keys).distinct(), keys, "left_semi")


def member_calls(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """Calls of the groups' variants, before any are gathered: for groups that hold a part of the variants only."""
    keys = ["chrom", "pos", "variant"]
    return calls.join(groups.select(*keys).distinct(), keys, "left_semi")


def surviving_pairs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs of which both variants are among the scores; within their group, where both have one."""
    keys = [*(["group"] if "group" in pairs.columns and "group" in scores.columns else []), "chrom"]
    kept = scores.select(*keys, "pos", "variant").distinct()
    for i in ("1", "2"):
        pairs = pairs.join(kept.select(*keys, F.col("pos").alias(f"pos{i}"), F.col("variant").alias(f"variant{i}")), [*keys, f"pos{i}", f"variant{i}"], "left_semi")
    return pairs


def response_variants(scores: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Each variant of a response once, with the first group that has it: by the mask's place if there is one, then by name."""
    rows = scores if groups is None else scores.join(groups, ["chrom", "pos", "variant"])
    order = F.struct(*[c for c in ("mask_place", "mask") if c in rows.columns], "group")
    first = F.min(F.struct(order.alias("o"), "alt_freq", "score_stat", "pvalue"))
    return rows.groupBy("chrom", "pos", "variant").agg(first.alias("f")).select("chrom", "pos", "variant", F.col("f.o.group").alias("first_group"), "f.alt_freq", "f.score_stat", "f.pvalue")
