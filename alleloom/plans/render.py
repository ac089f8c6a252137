"""Results in the response shapes: parallel arrays, or one compact matrix.

A response is one row and holds a page: more rows than a page may have are an error, not a larger row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.variants import colons, identifier_parts, rounded
from .requests import PAGE_LIMIT
from .runner import Answer

#: Fixed value: the offset of a row without pairs.
NO_OFFSET = -(2**31)


def _one_page(rows: DataFrame, what: Column, limit: int = PAGE_LIMIT) -> DataFrame:
    """One row ``r``: the sorted array of ``what``; an error if there are more than a page's."""
    many = F.raise_error(F.lit(f"a response holds {limit} rows at most"))
    gathered = rows.limit(limit + 1).agg(F.array_sort(F.collect_list(what)).alias("r"))
    return gathered.select(F.when(F.size("r") > limit, many.cast(gathered.schema["r"].dataType)).otherwise(F.col("r")).alias("r"))


def _arrays(page: DataFrame, fields: dict[str, str]) -> DataFrame:
    return page.select(*[F.col(f"r.{c}").alias(k) for k, c in fields.items()])


def classic(pairs: DataFrame, precision: int = 0) -> DataFrame:
    """One row: seven parallel arrays in order, for a page of pairs."""
    page = _one_page(pairs, F.struct("pos1", "variant1", "pos2", "variant2", "chrom", rounded(F.col("value"), precision).alias("value")))
    return _arrays(page, {"variant1": "variant1", "chromosome1": "chrom", "position1": "pos1", "variant2": "variant2", "chromosome2": "chrom", "position2": "pos2", "correlation": "value"})


def matrix_rows(pairs: DataFrame, precision: int = 0) -> DataFrame:
    """One row per variant of a page: its dense index, the offset of its first partner, and its values."""
    names = pairs.select("chrom", F.col("pos1").alias("pos"), F.col("variant1").alias("variant")).union(pairs.select("chrom", "pos2", "variant2")).distinct()
    # a page's variants
    dense = names.withColumn("idx", F.row_number().over(Window.orderBy("chrom", "pos", "variant")) - 1)
    for i in ("1", "2"):
        pairs = pairs.join(dense.select("chrom", F.col("pos").alias(f"pos{i}"), F.col("variant").alias(f"variant{i}"), F.col("idx").alias(f"idx{i}")), ["chrom", f"pos{i}", f"variant{i}"])
    rows = pairs.groupBy(F.col("idx1").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx2", rounded(F.col("value"), precision).alias("value")))).alias("r"))
    rows = rows.select("idx", F.col("r")[0]["idx2"].alias("offset"), F.col("r.value").alias("correlations"))
    return dense.join(rows, "idx", "left").select("idx", "chrom", "pos", "variant", F.coalesce("offset", F.lit(NO_OFFSET)).alias("offset"), F.coalesce("correlations", F.array().cast("array<double>")).alias("correlations"))


def compact(pairs: DataFrame, precision: int = 0) -> DataFrame:
    """One row: variants, chromosomes, positions, offsets, correlations of a page."""
    page = _one_page(matrix_rows(pairs, precision), F.struct("idx", "variant", "chrom", "pos", "offset", "correlations"))
    return _arrays(page, {"variants": "variant", "chromosomes": "chrom", "positions": "pos", "offsets": "offset", "correlations": "correlations"})


def _index_page(rows: DataFrame, precision: int) -> DataFrame:
    return _one_page(rows, F.struct("pos", "variant", "chrom", rounded(F.col("value"), precision).alias("value"), "index_variant", "index_pos"))


def variant_classic(rows: DataFrame, precision: int = 0) -> DataFrame:
    """One row: one variant against a region, as seven parallel arrays; the index variant's are repeated."""
    return _arrays(_index_page(rows, precision), {"variant1": "index_variant", "chromosome1": "chrom", "position1": "index_pos", "variant2": "variant", "chromosome2": "chrom", "position2": "pos", "correlation": "value"})


def variant_compact(rows: DataFrame, precision: int = 0) -> DataFrame:
    """One row: the index variant once (null if it isn't there), and arrays of the others."""
    page = _index_page(rows, precision)
    first = {"index_variant": "index_variant", "index_chromosome": "chrom", "index_position": "index_pos"}
    return page.select(*[F.get("r", F.lit(0))[c].alias(k) for k, c in first.items()], *[F.col(f"r.{c}").alias(k) for k, c in (("variants", "variant"), ("chromosomes", "chrom"), ("positions", "pos"), ("correlations", "value"))])


def scores(rows: DataFrame, sigma2: float | None = None, nsamples: int | None = None) -> DataFrame:
    """One row: parallel arrays of a page of score statistics, and the two scalars."""
    page = _one_page(rows, F.struct("pos", "variant", "chrom", "score_stat", "pvalue", "alt_freq"))
    out = _arrays(page, {"variant": "variant", "chromosome": "chrom", "position": "pos", "score_stat": "score_stat", "pvalue": "pvalue", "alt_freq": "alt_freq"})
    return out.select("*", F.lit(sigma2).cast("double").alias("sigma2"), F.lit(nsamples).cast("double").alias("nsamples"))


def as_json(result: DataFrame, next_: str | None = None, error: str | None = None) -> DataFrame:
    """The response text of a one-row result; NaN is null."""
    clean = [F.transform(c, lambda x: F.when(~F.isnan(x), x)).alias(c) if kind == "array<double>" else F.col(c) for c, kind in result.dtypes]
    body = F.struct(F.struct(*clean).alias("data"), F.lit(error).cast("string").alias("error"), F.lit(next_).cast("string").alias("next"))
    return result.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def _named(variant: Column, colons_wanted: bool) -> Column:
    return colons(*identifier_parts(variant)) if colons_wanted else variant


def aggregation(answer: Answer, group_type: str = "GENE", variant_format: str = "EPACTS", **datasets) -> DataFrame:
    """One row: variants, groups with their row-major upper triangles, and the request's scalars.

    ``datasets``: further scalars of the response, such as ``genotypeDataset`` or ``summaryStatisticDataset``.
    """
    wanted = variant_format == "COLONS"
    number = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    page = _one_page(answer.variants, F.struct("pos", "variant", "alt_freq", "pvalue", "score_stat"))
    variants = page.select(F.transform("r", lambda v: F.struct(_named(v["variant"], wanted).alias("variant"), v["alt_freq"].alias("altFreq"), F.when(~F.isnan(v["pvalue"]), v["pvalue"]).alias("pvalue"), F.when(~F.isnan(v["score_stat"]), v["score_stat"]).alias("score"))).alias("variants"))
    keys = ["mask_place", "mask", "group"]
    triangle = answer.pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos1", "variant1", "pos2", "variant2", number("value").alias("value")))).alias("p"))
    own = answer.members.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("pos", "variant"))).alias("v"))
    rows = own.join(answer.groups, keys).join(triangle, keys, "left")
    group = F.struct(*keys, F.lit(group_type).alias("groupType"), F.transform("v", lambda v: _named(v["variant"], wanted)).alias("variants"), F.coalesce("p.value", F.array().cast("array<double>")).alias("covariance"), F.col("mean_minor_freq").alias("meanMinorFreq"))
    groups = _one_page(rows, group).select(F.transform("r", lambda g: g.dropFields("mask_place")).alias("groups"))
    scalars = [F.lit(answer.sigma2).cast("double").alias("sigmaSquared"), F.lit(answer.nsamples).cast("double").alias("nSamples"), *[F.lit(v).alias(k) for k, v in datasets.items()]]
    return variants.join(F.broadcast(groups)).select("variants", "groups", *scalars)


def empty_aggregation(spark, **datasets) -> DataFrame:
    """The response where a request's region has no variants at all."""
    one = spark.range(1)
    variant = "array<struct<variant string, altFreq double, pvalue double, score double>>"
    group = "array<struct<mask string, group string, groupType string, variants array<string>, covariance array<double>, meanMinorFreq double>>"
    return one.select(F.array().cast(variant).alias("variants"), F.array().cast(group).alias("groups"), F.lit(None).cast("double").alias("sigmaSquared"), F.lit(None).cast("double").alias("nSamples"), *[F.lit(v).alias(k) for k, v in datasets.items()])
