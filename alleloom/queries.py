"""Registered queries: the library's operators on genetics tables derived from the sales tables, with SQL for each.

A part is a variant (its key the position on chromosome 1), a customer a sample, and a part in
a customer's orders a carried allele. Some calls count as missing by a fixed rule. Account
balances are a phenotype, brands are genes, and nations populations.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import variants as V
from .operators import bitset, genotype, intervals, ld, phenotypes, score, sumstats
from .operators.listing import list_variants
from .plans import paging, render, runner
from .plans.cellstore import CellStore
from .sources import files
from .sources.catalog import Catalog
from .sources.files import group_bounds, region_groups

#: The region of the region queries; all others take every variant.
START, STOP = 0, 299
#: The p-value expression of the SQL side, with t = 1 / (1 + x / 2) and x = |z| / sqrt(2).
_T = "(1e0 / (1e0 + 0.5e0 * ({x})))"


def _p_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2e0))"
    t = _T.format(x=x)
    poly = f"{V.ERFC[-1]!r}::DOUBLE"
    for c in reversed(V.ERFC[1:-1]):
        poly = f"({c!r}::DOUBLE + {t} * {poly})"
    return f"({t} * exp(-{x} * {x} + {V.ERFC[0]!r}::DOUBLE + {t} * {poly}))"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _carried(spark: SparkSession, sf_dir: str, start: int | None, stop: int | None, only: DataFrame | None = None) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    if start is not None:
        lines = lines.where(F.col("l_partkey").between(start, stop))
    if only is not None:
        lines = lines.join(only.select(F.col("pos").alias("l_partkey")), "l_partkey", "left_semi")
    return lines.join(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def calls(spark: SparkSession, sf_dir: str, start: int | None = None, stop: int | None = None, haplotypes: bool = False, only: DataFrame | None = None) -> DataFrame:
    """All calls, or those of a region or of the positions in ``only(pos)``; the bounds are pushed to the scan of lineitem.

    A line's number says which of a customer's two haplotypes carries the part.
    """
    hap = [(F.col("l_linenumber") % 2).alias("hap")] if haplotypes else []
    count = F.lit(1) if haplotypes else F.least(F.count("*"), F.lit(2))
    dosage = F.when((F.max("l_linenumber") >= 4) & (F.min("l_quantity") < 4), None).otherwise(count.cast("double"))
    out = _carried(spark, sf_dir, start, stop, only).groupBy(F.col("l_partkey").alias("pos"), F.col("o_custkey").alias("sample"), *hap).agg(dosage.alias("dosage"))
    name = V.epacts(F.lit("1"), F.col("pos"), F.lit("A"), F.lit("T"))
    return out.select(F.lit("1").alias("chrom"), "pos", name.alias("variant"), "sample", *(["hap"] if haplotypes else []), "dosage")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), "c_nationkey", "c_mktsegment", "c_acctbal")


def phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("sample", F.when(F.col("sample") % 17 != 0, F.col("c_acctbal")).alias("y"))


def europeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A population: customers of one region's nations."""
    n = _read(spark, sf_dir, "nation").where("n_regionkey = 3").select("n_nationkey")
    return samples(spark, sf_dir).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("sample")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("group"), F.lit("1").alias("chrom"), F.col("p_partkey").alias("pos"), V.epacts(F.lit("1"), F.col("p_partkey"), F.lit("A"), F.lit("T")).alias("variant"))


def _n(rows: DataFrame) -> int:
    return rows.count()


def _pairs(rows: DataFrame, digits: int = 8) -> DataFrame:
    return rows.select("pos1", "pos2", V.rounded_fast(F.col("value"), digits).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _calls_sql(start: int | None = None, stop: int | None = None, subset: bool = False, haplotypes: bool = False) -> str:
    where = f"WHERE l_partkey BETWEEN {start} AND {stop}" if start is not None else ""
    keep = "AND o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3)" if subset else ""
    count, hap = ("1", ", l_linenumber % 2 AS hap") if haplotypes else ("least(count(*), 2)", "")
    g = f"CASE WHEN max(l_linenumber) >= 4 AND min(l_quantity) < 4 THEN NULL ELSE {count}::DOUBLE END"
    return f"c AS (SELECT l_partkey AS pos, o_custkey AS sample{hap}, {g} AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey {keep} {where} GROUP BY ALL)"


_ALL, _SUBSET = "SELECT count(*) FROM customer", "SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3"


def _ld_sql(metric: str, start: int | None = START, stop: int | None = STOP, diagonal: bool = False, subset: bool = False, haplotypes: bool = False, within: str = "") -> str:
    """x, sums s and pairs p(pos1, pos2, s1, s2, s12), then the value; ``within``: which pairs only."""
    key = "sample, hap" if haplotypes else "sample"
    x = f"SELECT pos, {key}, {'coalesce(dosage, m)' if metric == 'cov' else '1e0'} AS x FROM c JOIN k USING (pos)"
    value = {
        "r": "(n * s12 - s1 * s2) / nullif(sqrt(s1 * s2 * (n - s1) * (n - s2)), 0)",
        "rsquare": "pow((n * s12 - s1 * s2) / nullif(sqrt(s1 * s2 * (n - s1) * (n - s2)), 0), 2)",
        "rsquare_approx": "pow(s12 / n - s1 / n * s2 / n, 2) / nullif(s1 / n * (1 - s1 / n) * s2 / n * (1 - s2 / n), 0)",
        "cov": "s12 / n - s1 * s2 / (n * n)",
        "dprime": "(s12 / n - s1 / n * s2 / n) / nullif(CASE WHEN s12 / n - s1 / n * s2 / n < 0 THEN least(s1 / n * s2 / n, (1 - s1 / n) * (1 - s2 / n)) ELSE least(s1 / n * (1 - s2 / n), s2 / n * (1 - s1 / n)) END, 0)",
    }[metric]
    return f"""{_calls_sql(start, stop, subset, haplotypes)},
n AS (SELECT {2 if haplotypes else 1} * ({_SUBSET if subset else _ALL})::DOUBLE AS n),
k AS (SELECT pos, sum(dosage) / (SELECT n FROM n) AS m FROM c GROUP BY pos HAVING sum(dosage) > 0),
x AS ({x}), s AS (SELECT pos, sum(x) AS s FROM x GROUP BY pos),
b AS (SELECT a.pos AS pos1, b.pos AS pos2, sum(a.x * b.x) AS s12 FROM x a JOIN x b USING ({key}) GROUP BY 1, 2),
p AS (SELECT a.pos AS pos1, z.pos AS pos2, a.s AS s1, z.s AS s2, coalesce(s12, 0) AS s12, n FROM s a JOIN s z ON a.pos {"<=" if diagonal else "<"} z.pos {within}
      LEFT JOIN b ON b.pos1 = a.pos AND b.pos2 = z.pos CROSS JOIN n),
v AS (SELECT pos1, pos2, {value} AS value FROM p)"""


def _region_query(name: str, metric: str, start: int = START, stop: int = STOP, diagonal: bool = False, subset: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        people = europeans(spark, sf_dir) if subset else samples(spark, sf_dir)
        rows = genotype.of_samples(calls(spark, sf_dir, start, stop), people if subset else None)
        return _pairs(ld.region(rows, _n(people), "1", start, stop, metric, diagonal))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {_ld_sql(metric, start, stop, diagonal, subset)} SELECT pos1, pos2, round(value, 8) AS value FROM v"


_region_query("ld_region_rsquare", "rsquare")
_region_query("ld_region_r", "r")
_region_query("ld_region_rsquare_approx", "rsquare_approx")
_region_query("ld_region_cov_missing", "cov", 0, 99)
_region_query("ld_region_dprime", "dprime", 0, 99)
_region_query("ld_region_diagonal", "cov", 0, 79, True)
_region_query("ld_subset_rsquare", "rsquare", 0, 149, False, True)


def _haplotype_query(name: str, metric: str, start: int, stop: int, packed: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        everyone = samples(spark, sf_dir)
        n, some = genotype.size(everyone, haplotypes=True), calls(spark, sf_dir, start, stop, haplotypes=True)
        if packed:
            return _pairs(bitset.region_pairs(bitset.packed(some, bitset.numbered(everyone, n)), n, metric))
        return _pairs(ld.region(some, n, "1", start, stop, metric))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {_ld_sql(metric, start, stop, haplotypes=True)} SELECT pos1, pos2, round(value, 8) AS value FROM v"


_haplotype_query("ld_haplotype_rsquare", "rsquare", 0, 299)
_haplotype_query("ld_haplotype_r", "r", 0, 149)
_haplotype_query("ld_haplotype_rsquare_approx", "rsquare_approx", 0, 149, True)
_haplotype_query("ld_haplotype_dprime", "dprime", 0, 149, True)


def _index_query(name: str, metric: str, index: int, start: int, stop: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = calls(spark, sf_dir, min(index, start), max(index, stop))
        return ld.variant(rows, _n(samples(spark, sf_dir)), f"1:{index}_A/T", "1", start, stop, metric).select("index_pos", "pos", F.round("value", 8).alias("value"))

    QUERIES[name] = run
    pairs = _ld_sql(metric, min(index, start), max(index, stop), True)
    ORACLES[name] = f"WITH {pairs} SELECT {index}::BIGINT AS index_pos, CASE WHEN pos1 = {index} THEN pos2 ELSE pos1 END AS pos, round(value, 8) AS value FROM v WHERE {index} IN (pos1, pos2) AND CASE WHEN pos1 = {index} THEN pos2 ELSE pos1 END BETWEEN {start} AND {stop}"


_index_query("ld_variant_rsquare", "rsquare", 50, 0, 199)
_index_query("ld_variant_outside_region", "r", 150, 0, 99)
_index_query("ld_variant_cov", "cov", 20, 0, 99)


@query(f"WITH {_ld_sql('rsquare', 0, 149)} SELECT pos1, pos2, round(value, 8) AS value FROM v")
def ld_region_dense(spark, sf_dir):
    return _pairs(ld.dense_pairs(calls(spark, sf_dir, 0, 149), _n(samples(spark, sf_dir)), "rsquare"))


@query(f"""WITH {_calls_sql()}, n AS (SELECT ({_ALL})::DOUBLE AS n)
SELECT pos, sum(dosage) AS ac, round(sum(dosage) / n, 9) AS mean, round(sum(dosage) / (2 * n), 9) AS af, sum((dosage IS NULL)::INT)::BIGINT AS n_missing FROM c, n GROUP BY pos, n HAVING sum(dosage) > 0""")
def variant_frequency(spark, sf_dir):
    f = genotype.frequencies(calls(spark, sf_dir), _n(samples(spark, sf_dir)))
    return f.select("pos", "ac", F.round("mean", 9).alias("mean"), F.round("af", 9).alias("af"), "n_missing")


@query(f"WITH {_calls_sql(subset=True)} SELECT pos, count(*) AS n_calls FROM c WHERE pos IN (SELECT pos FROM c WHERE dosage > 0) GROUP BY pos")
def monomorphic_drop(spark, sf_dir):
    rows = genotype.of_samples(calls(spark, sf_dir), europeans(spark, sf_dir))
    return genotype.polymorphic(rows).groupBy("pos").agg(F.count("*").alias("n_calls"))


@query(f"WITH {_calls_sql(subset=True)} SELECT pos, sample, dosage FROM c")
def sample_subset_semi_join(spark, sf_dir):
    return genotype.of_samples(calls(spark, sf_dir), europeans(spark, sf_dir)).select("pos", "sample", "dosage")


def _morton_sql(i: str, j: str) -> str:
    def spread(x: str) -> str:
        for shift, mask in V.SPREAD:
            x = f"(({x} | ({x} << {shift})) & {mask})" if shift == 16 else f"(SELECT (q | (q << {shift})) & {mask} FROM (SELECT {x} AS q))"
        return x

    return f"({spread(f'({i})::BIGINT')} | ({spread(f'({j})::BIGINT')} << 1))"


@query(f"SELECT p_partkey AS i, p_size AS j, {_morton_sql('p_partkey', 'p_size')} AS code FROM part")
def morton_code(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("i"), F.col("p_size").alias("j"), V.morton(F.col("p_partkey"), F.col("p_size")).alias("code"))


@query(f"SELECT i, j, {_morton_sql('i', 'j')} AS cell FROM (SELECT DISTINCT p_partkey // 50 AS i FROM part) a, (SELECT DISTINCT p_partkey // 50 AS j FROM part) b WHERE i <= j")
def allowed_segment_pairs(spark, sf_dir):
    return paging.allowed_cells(genes(spark, sf_dir).select("chrom", "pos"), 50).select("i", "j", "cell")


def _page_sql(skip: int) -> str:
    return f"WITH {_ld_sql('rsquare', 0, 99)}, q AS (SELECT pos1, pos2, round(value, 8) AS value, {_morton_sql('pos1 // 20', 'pos2 // 20')} AS cell FROM v) SELECT * FROM q ORDER BY cell, pos1, pos2 LIMIT 500 OFFSET {skip}"


def _page(spark, sf_dir, after=None):
    return paging.region_page(calls(spark, sf_dir, 0, 99), _n(samples(spark, sf_dir)), "1", 0, 99, "rsquare", 20, 500, after)


@query(_page_sql(0))
def ld_page_1(spark, sf_dir):
    return _page(spark, sf_dir).select("pos1", "pos2", F.round("value", 8).alias("value"), "cell")


@query(_page_sql(500))
def ld_page_2(spark, sf_dir):
    first = _page(spark, sf_dir).collect()  # a page is bounded by its limit
    return _page(spark, sf_dir, paging.next_cursor(first, paging.PAIR_ORDER, 500)).select("pos1", "pos2", F.round("value", 8).alias("value"), "cell")


@query(f"""WITH {_ld_sql('rsquare', 0, 299, True)}, q AS (SELECT CASE WHEN pos1 = 130 THEN pos2 ELSE pos1 END AS pos, round(value, 8) AS value, {_morton_sql('pos1 // 20', 'pos2 // 20')} AS cell FROM v WHERE 130 IN (pos1, pos2))
SELECT pos, value, cell FROM q ORDER BY cell, pos LIMIT 50 OFFSET 50""")
def ld_variant_page_2(spark, sf_dir):
    def part(after=None):
        return paging.variant_page(calls(spark, sf_dir, 0, 299), _n(samples(spark, sf_dir)), "1:130:A:T", "1", 0, 299, "rsquare", 20, 50, after)

    first = part().collect()  # a page is bounded by its limit
    return part(paging.next_cursor(first, paging.VARIANT_ORDER, 50)).select("pos", F.round("value", 8).alias("value"), "cell")


_Y = "y AS (SELECT c_custkey AS sample, c_acctbal AS y FROM customer WHERE c_custkey % 17 <> 0)"


@query(f"WITH {_Y} SELECT count(*) AS nsamples, round(avg(y), 6) AS mean, round(var_pop(y), 4) AS sigma2 FROM y")
def phenotype_sigma2(spark, sf_dir):
    return score.moments(phenotype(spark, sf_dir)).select("nsamples", F.round("mean", 6).alias("mean"), F.round("sigma2", 4).alias("sigma2"))


@query("SELECT c_custkey AS sample, c_acctbal AS y FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def complete_samples(spark, sf_dir):
    have = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample"))
    return score.complete(score.aligned(have, phenotype(spark, sf_dir)))


@query("WITH f AS (SELECT c_mktsegment AS level, min(c_custkey) AS line FROM customer GROUP BY 1) SELECT level, row_number() OVER (ORDER BY line, level) - 1 AS code FROM f")
def categorical_encode(spark, sf_dir):
    return phenotypes.encode_by_appearance(samples(spark, sf_dir), "c_mktsegment", "sample")


_SCORES = f"""{_calls_sql()}, {_Y},
m AS (SELECT count(*)::DOUBLE AS n, avg(y) AS mean, var_pop(y) AS sigma2 FROM y),
u AS (SELECT pos, n, sigma2, sum(dosage) AS s, sum(dosage * dosage) AS ss, sum((dosage IS NULL)::INT) AS missing, sum(dosage * (y - mean)) AS carried, coalesce(sum(CASE WHEN dosage IS NULL THEN y - mean END), 0) AS absent
      FROM c JOIN y USING (sample) CROSS JOIN m GROUP BY pos, n, sigma2 HAVING sum(dosage) > 0),
w AS (SELECT pos, s / (2 * n) AS alt_freq, sigma2, carried + s / n * absent AS u, (ss - 2 * (s / n) * s + (n - missing) * (s / n) * (s / n)) * sigma2 AS v FROM u),
scores AS (SELECT pos, alt_freq, u / nullif(sigma2, 0) AS score_stat, {_p_sql("(u / nullif(sqrt(v), 0))")} AS pvalue FROM w)"""


def _scores(spark, sf_dir):
    return score.score_statistics(calls(spark, sf_dir), phenotype(spark, sf_dir))


@query(f"WITH {_SCORES} SELECT pos, round(score_stat, 8) AS score_stat, pos // 100 AS segment FROM scores ORDER BY segment, pos LIMIT 120 OFFSET 120")
def score_page_2(spark, sf_dir):
    first = paging.score_page(_scores(spark, sf_dir), 100, 120).collect()  # a page is bounded by its limit
    rows = paging.score_page(_scores(spark, sf_dir), 100, 120, paging.next_cursor(first, paging.SCORE_ORDER, 120))
    return rows.select("pos", F.round("score_stat", 8).alias("score_stat"), "segment")


@query(f"WITH {_SCORES} SELECT pos, round(alt_freq, 9) AS alt_freq, round(score_stat, 8) AS score_stat, round(pvalue, 7) AS pvalue FROM scores")
def score_stat(spark, sf_dir):
    return _scores(spark, sf_dir).select("pos", F.round("alt_freq", 9).alias("alt_freq"), F.round("score_stat", 8).alias("score_stat"), F.round("pvalue", 7).alias("pvalue"))


@query(f"""WITH {_calls_sql()}, {_Y}, m AS (SELECT count(*) AS n, sum(y) AS sum_y, var_pop(y) AS sigma2 FROM y),
u AS (SELECT pos, sigma2, sum(dosage * y) - sum(dosage) / n * (sum_y - coalesce(sum(CASE WHEN dosage IS NULL THEN y END), 0)) AS u FROM c JOIN y USING (sample) CROSS JOIN m GROUP BY pos, n, sum_y, sigma2 HAVING sum(dosage) > 0)
SELECT pos, round(u, 5) AS score_stat, round({_p_sql("(u / nullif(sqrt(sigma2), 0))")}, 7) AS pvalue FROM u""")
def score_legacy(spark, sf_dir):
    rows = score.legacy_score(calls(spark, sf_dir), phenotype(spark, sf_dir))
    return rows.select("pos", F.round("score_stat", 5).alias("score_stat"), F.round("pvalue", 7).alias("pvalue"))


_GENES = "g AS (SELECT p_brand AS grp, p_partkey AS pos FROM part)"
_SAME_GENE = "AND EXISTS (SELECT 1 FROM part p, part q WHERE p.p_partkey = a.pos AND q.p_partkey = z.pos AND p.p_brand = q.p_brand)"
_SAME_BLOCK = "AND a.pos // 40 = z.pos // 40"


@query(f"""WITH {_ld_sql("cov", None, None, True)}, {_GENES}
SELECT a.grp AS "group", pos1, pos2, round(value, 8) AS value FROM v JOIN g a ON a.pos = pos1 JOIN g b ON b.pos = pos2 AND a.grp = b.grp""")
def group_covariance(spark, sf_dir):
    return score.group_covariance(calls(spark, sf_dir), genes(spark, sf_dir), _n(samples(spark, sf_dir))).select("group", "pos1", "pos2", V.rounded_fast(F.col("value"), 8).alias("value"))


@query(f'WITH {_SCORES}, {_GENES} SELECT grp AS "group", round(avg(least(alt_freq, 1 - alt_freq)), 9) AS mean_minor_freq, count(*) AS n_variants FROM scores JOIN g USING (pos) GROUP BY grp')
def group_mean_minor_freq(spark, sf_dir):
    return score.group_minor_frequency(_scores(spark, sf_dir), genes(spark, sf_dir)).select("group", F.round("mean_minor_freq", 9).alias("mean_minor_freq"), "n_variants")


@query(f"WITH {_SCORES} SELECT pos, round(alt_freq, 9) AS alt_freq FROM scores WHERE least(alt_freq, 1 - alt_freq) <= 0.01 AND least(alt_freq, 1 - alt_freq) >= 0.002")
def group_filter_maf(spark, sf_dir):
    rows = score.filtered(_scores(spark, sf_dir), [{"field": "maf", "op": "lte", "value": 0.01}, {"field": "maf", "op": "gte", "value": 0.002}])
    return rows.select("pos", F.round("alt_freq", 9).alias("alt_freq"))


#: The scores beside the pairs of one statement: the calls are there already, and m has another meaning.
_BOTH = f"{_ld_sql('cov', None, None, True)}, {_SCORES.replace(_calls_sql() + ',', '').replace('m AS (', 'mm AS (').replace('CROSS JOIN m ', 'CROSS JOIN mm ')}, {_GENES}"


@query(f"""WITH {_BOTH}
SELECT pos1, pos2, round(value, 8) AS value FROM v JOIN g a ON a.pos = pos1 JOIN g b ON b.pos = pos2 AND a.grp = b.grp
WHERE pos1 IN (SELECT pos FROM scores WHERE pvalue <= 0.2) AND pos2 IN (SELECT pos FROM scores WHERE pvalue <= 0.2)""")
def group_filter_pvalue(spark, sf_dir):
    kept = score.filtered(_scores(spark, sf_dir), [{"field": "pvalue", "op": "lte", "value": 0.2}])
    groups = score.surviving_groups(genes(spark, sf_dir), kept)
    return _pairs(score.group_covariance(score.member_calls(calls(spark, sf_dir), groups), groups, _n(samples(spark, sf_dir))))


def _masks(spark, sf_dir) -> DataFrame:
    """Two masks: brands, then sizes."""
    sizes = _read(spark, sf_dir, "part").select(F.concat(F.lit("size"), F.col("p_size")).alias("group"), F.col("p_partkey").alias("pos"))
    sizes = genes(spark, sf_dir).drop("group").join(sizes, "pos")
    return runner.masked([("brands", genes(spark, sf_dir)), ("sizes", sizes)])


_MASKS = "mk AS (SELECT 0 AS place, 'brands' AS mask, p_brand AS grp, p_partkey AS pos FROM part UNION ALL SELECT 1, 'sizes', 'size' || p_size, p_partkey FROM part)"


@query(f"WITH {_SCORES}, {_MASKS} SELECT pos, arg_min(grp, place || grp) AS first_group, round(any_value(alt_freq), 9) AS alt_freq, round(any_value(pvalue), 7) AS pvalue FROM scores JOIN mk USING (pos) GROUP BY pos")
def response_variants_dedup(spark, sf_dir):
    rows = score.response_variants(_scores(spark, sf_dir), _masks(spark, sf_dir))
    return rows.select("pos", "first_group", F.round("alt_freq", 9).alias("alt_freq"), F.round("pvalue", 7).alias("pvalue"))


_FILTERS = [{"field": "pvalue", "op": "lte", "value": 0.1}, {"field": "maf", "op": "gte", "value": 0.002}]
_PASSED = "scores WHERE pvalue <= 0.1 AND least(alt_freq, 1 - alt_freq) >= 0.002"
#: Samples with a phenotype alone count, on both sides.
_RUN = f"{_BOTH.replace('ON l_orderkey = o_orderkey', 'ON l_orderkey = o_orderkey AND o_custkey % 17 <> 0').replace(f'({_ALL})', f'({_ALL} WHERE c_custkey % 17 <> 0)')}, {_MASKS}"


def _compute(spark, sf_dir) -> runner.Answer:
    return runner.compute(calls(spark, sf_dir), samples(spark, sf_dir), phenotype(spark, sf_dir), _masks(spark, sf_dir), _FILTERS)


@query(f"""WITH {_RUN}, q AS (SELECT * FROM {_PASSED}), s2 AS (SELECT sigma2 FROM mm)
SELECT a.mask, a.grp AS "group", pos1, pos2, round(value / sigma2, 14) AS value FROM v JOIN mk a ON a.pos = pos1 JOIN mk b ON b.pos = pos2 AND a.grp = b.grp AND a.mask = b.mask CROSS JOIN s2
WHERE pos1 IN (SELECT pos FROM q) AND pos2 IN (SELECT pos FROM q)""")
def aggregation_pairs(spark, sf_dir):
    return _compute(spark, sf_dir).pairs.select("mask", "group", "pos1", "pos2", F.round("value", 14).alias("value"))


@query(f"""WITH {_RUN}, q AS (SELECT * FROM {_PASSED})
SELECT mask, grp AS "group", count(*) AS n_variants, round(avg(least(alt_freq, 1 - alt_freq)), 9) AS mean_minor_freq, (SELECT n::BIGINT FROM mm) AS nsamples FROM q JOIN mk USING (pos) GROUP BY mask, grp""")
def aggregation_groups(spark, sf_dir):
    a = _compute(spark, sf_dir)
    return a.groups.select("mask", "group", "n_variants", F.round("mean_minor_freq", 9).alias("mean_minor_freq"), F.lit(a.nsamples).cast("long").alias("nsamples"))


@query(f"WITH {_RUN}, q AS (SELECT * FROM {_PASSED}) SELECT pos, round(alt_freq, 9) AS alt_freq, round(score_stat, 8) AS score_stat, round(pvalue, 7) AS pvalue FROM q")
def aggregation_variants(spark, sf_dir):
    rows = _compute(spark, sf_dir).variants
    return rows.select("pos", F.round("alt_freq", 9).alias("alt_freq"), F.round("score_stat", 8).alias("score_stat"), F.round("pvalue", 7).alias("pvalue"))


def _region_group(spark, sf_dir):
    """A region of 100 positions from every 80th on."""
    k = F.floor(F.col("p_partkey") / 80)
    bounds = _read(spark, sf_dir, "part").select(k.alias("k")).distinct().select(F.concat(F.lit("R"), F.col("k")).alias("group"), F.lit("1").alias("chrom"), (F.col("k") * 80).alias("start"), (F.col("k") * 80 + 99).alias("stop"))
    return region_groups(bounds, genes(spark, sf_dir).drop("group"))


@query("WITH r AS (SELECT DISTINCT 'R' || (p_partkey // 80) AS grp, p_partkey // 80 * 80 AS a, p_partkey // 80 * 80 + 99 AS b FROM part) SELECT grp AS \"group\", count(*) AS n_variants, min(p_partkey) AS first_pos FROM part JOIN r ON p_partkey BETWEEN a AND b GROUP BY grp")
def region_group_members(spark, sf_dir):
    return _region_group(spark, sf_dir).groupBy("group").agg(F.count("*").alias("n_variants"), F.min("pos").alias("first_pos"))


@query('SELECT p_brand AS "group", min(p_partkey) AS start, max(p_partkey) AS stop FROM part GROUP BY p_brand')
def mask_bounds(spark, sf_dir):
    return group_bounds(genes(spark, sf_dir)).select("group", "start", "stop").distinct()


def _blocks_of_40(spark, sf_dir) -> DataFrame:
    return genes(spark, sf_dir).withColumn("group", F.floor(F.col("pos") / 40).cast("string"))


def _cov_file(spark, sf_dir):
    """A covariance file's rows: for each variant the positions after it in its block of 40 and their covariances, as text."""
    pairs = score.group_covariance(calls(spark, sf_dir), _blocks_of_40(spark, sf_dir), _n(samples(spark, sf_dir)))
    rows = F.array_sort(F.collect_list(F.struct("pos2", F.round("value", 8).alias("value"))))
    return pairs.groupBy("chrom", F.col("pos1").alias("pos")).agg(rows.alias("r")).select("chrom", "pos", F.array_join(F.transform("r.pos2", lambda p: p.cast("string")), ",").alias("positions"), F.array_join(F.transform("r.value", lambda v: F.concat(v.cast("string"), F.lit(":0"))), ",").alias("covs"))


@query(f"WITH {_ld_sql('cov', None, None, True, within=_SAME_BLOCK)} SELECT pos1, pos2, round(value, 8) AS value FROM v")
def cov_row_explode(spark, sf_dir):
    return _pairs(sumstats.covariance_rows(_cov_file(spark, sf_dir)))


_FLIPPED = f"""WITH {_ld_sql('cov', None, None, True, within=_SAME_BLOCK)}, o AS (SELECT pos1, pos2, round(CASE WHEN pos1 <> pos2 AND (pos1 % 3 = 0) <> (pos2 % 3 = 0) THEN -value ELSE value END, 8) AS value FROM v)"""


def _stated_scores(spark, sf_dir) -> DataFrame:
    """A score file's rows, with frequencies over one half for every third variant."""
    return genes(spark, sf_dir).select("chrom", "pos", "variant", F.col("pos").alias("line"), F.when(F.col("pos") % 3 == 0, 0.9e0).otherwise(0.1e0).alias("alt_freq"), F.col("pos").cast("double").alias("score_stat"), F.lit(0.5e0).alias("pvalue"))


@query(f"{_FLIPPED} SELECT * FROM o")
def cov_sign_flip(spark, sf_dir):
    return _pairs(sumstats.lookup(sumstats.covariance_rows(_cov_file(spark, sf_dir)), _stated_scores(spark, sf_dir)))


@query(f"{_FLIPPED} SELECT * FROM o WHERE pos1 >= 10 AND pos2 <= 69")
def cov_load_region(spark, sf_dir):
    return _pairs(sumstats.load_region(_cov_file(spark, sf_dir), _stated_scores(spark, sf_dir), "1", 10, 69))


@query(f"{_FLIPPED} SELECT pos1 // 40 AS block, pos1, pos2, value FROM o")
def aggregation_precomputed(spark, sf_dir):
    masks = runner.masked([("blocks", _blocks_of_40(spark, sf_dir))])
    rows = runner.precomputed(_stated_scores(spark, sf_dir), _cov_file(spark, sf_dir), masks).pairs
    return rows.select(F.col("group").cast("long").alias("block"), "pos1", "pos2", F.round("value", 8).alias("value"))


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def cov_positions(spark, sf_dir):
    from .sources.files import covariance_positions

    return spark.createDataFrame([(covariance_positions(_cov_file(spark, sf_dir)),)], "n long")


@query("""SELECT p_partkey AS pos, round(CASE p_partkey % 3 WHEN 0 THEN p_size / 100e0 ELSE p_size / (2e0 * 1000) END, 9) AS alt_freq FROM part""")
def af_fallback(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    af = F.when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_size") / 100).cast("string"), F.lit(":0.1:0.2"))).when(F.col("p_partkey") % 3 == 1, "NA").otherwise("")
    return p.select(F.col("p_partkey").alias("pos"), F.round(V.alt_frequency(af, F.concat(F.col("p_size").cast("string"), F.lit(":1:2")), F.lit("1000:500:500")), 9).alias("alt_freq"))


def _block_inputs(spark, sf_dir):
    """Blocks of 40 variants; covariate sums are embeddings, and GtG the sums of products of calls."""
    n = _n(samples(spark, sf_dir))
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("gtu"))
    held = calls(spark, sf_dir, only=e)  # variants without covariate sums are in no block
    f = genotype.frequencies(held, n)
    rows = f.join(e, "pos").select(F.floor(F.col("pos") / 40).cast("int").alias("block"), "chrom", "pos", "variant", F.lit("A").alias("ref"), F.lit("T").alias("alt"), F.col("af").alias("maf"), F.lit(n).alias("n"), "gtu", F.lit(0.008e0).alias("cutoff"), F.col("ac").alias("alt_ac"), (F.col("ac") - 20).alias("u"), F.col("ss").alias("v"))
    v = sumstats.cutoff_variants(rows)
    c = held.where("dosage > 0").join(v.select("pos", "block", "local", "idx", "offset"), "pos")
    near = F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block2")
    a, b = c.select("block", near, F.col("idx").alias("idx1"), F.col("local").alias("row"), "offset", "sample", F.col("dosage").alias("d1")), c.select(F.col("block").alias("block2"), F.col("idx").alias("idx2"), "sample", F.col("dosage").alias("d2"))
    both = a.join(b, ["sample", "block2"]).where("idx1 <= idx2")
    return v, both.groupBy("block", "row", (F.col("idx2") - F.col("offset")).alias("col")).agg(F.sum(F.col("d1") * F.col("d2")).alias("gtg"))


_BLOCKS = f"""{_calls_sql()}, n AS (SELECT ({_ALL})::DOUBLE AS n),
f AS (SELECT pos, pos // 40 AS block, sum(dosage) AS ac, sum(dosage) / (2 * n) AS af, n, sum(dosage * dosage) AS ss FROM c, n GROUP BY pos, n HAVING sum(dosage) > 0),
v AS (SELECT pos, block, ac, ss, n, list_transform(embedding, lambda x: x::DOUBLE) AS gtu, row_number() OVER (ORDER BY pos) - 1 AS idx FROM f JOIN embeddings ON vec_id = pos WHERE af < 0.008),
gg AS (SELECT a.pos AS p1, b.pos AS p2, sum(a.dosage * b.dosage) AS gtg FROM c a JOIN c b USING (sample) WHERE a.pos <= b.pos GROUP BY 1, 2)"""


@query(f"""WITH {_BLOCKS} SELECT a.idx AS idx1, b.idx AS idx2, round((coalesce(gtg, 0) - list_inner_product(a.gtu, b.gtu)) / a.n, 8) AS value
FROM v a JOIN v b ON a.idx <= b.idx AND b.block - a.block <= 1 LEFT JOIN gg ON p1 = a.pos AND p2 = b.pos""")
def metastaar_cov(spark, sf_dir):
    return sumstats.block_covariance(*_block_inputs(spark, sf_dir)).select("idx1", "idx2", F.round("value", 8).alias("value"))


@query(f"WITH {_BLOCKS} SELECT pos, block::INT AS block, idx, idx - min(idx) OVER (PARTITION BY block) AS local FROM v")
def metastaar_block_offsets(spark, sf_dir):
    return _block_inputs(spark, sf_dir)[0].select("pos", "block", "idx", "local")


@query(f"""WITH {_BLOCKS}, z AS (SELECT pos, ac, n, (ac - 20) / nullif(sqrt(ss), 0) AS z FROM v) SELECT pos, round(z, 8) AS z, round({_p_sql("z")}, 7) AS pvalue, round(ac / (2 * n), 9) AS alt_freq FROM z""")
def metastaar_scores(spark, sf_dir):
    return sumstats.block_scores(_block_inputs(spark, sf_dir)[0]).select("pos", F.round("z", 8).alias("z"), F.round("pvalue", 7).alias("pvalue"), F.round("alt_freq", 9).alias("alt_freq"))


def _region_files(spark, sf_dir):
    """Files of 150 positions, one from each 100th on that has parts."""
    k = F.floor(F.col("p_partkey") / 100)
    return _read(spark, sf_dir, "part").select(k.alias("k")).distinct().select(F.concat(F.lit("f"), F.col("k")).alias("path"), F.lit("1").alias("chrom"), (F.col("k") * 100).alias("region_start"), (F.col("k") * 100 + 149).alias("region_mid"))


_FILES = "f AS (SELECT DISTINCT 'f' || (p_partkey // 100) AS path, p_partkey // 100 * 100 AS region_start, p_partkey // 100 * 100 + 149 AS region_mid FROM part)"


@query(f"WITH {_FILES} SELECT path, region_start FROM f WHERE region_start <= 750 AND region_mid >= 320")
def interval_overlap_files(spark, sf_dir):
    return sumstats.files_overlapping(_region_files(spark, sf_dir), "1", 320, 750).select("path", "region_start")


@query(f"""WITH {_FILES}, g AS (SELECT p_brand || p_size AS grp, min(p_partkey) AS a, max(p_partkey) AS b FROM part GROUP BY grp)
SELECT grp AS "group", count(*) AS n_files, min(path) AS first_path, max(region_start) AS last_start FROM g JOIN f ON region_start <= b AND region_mid >= a GROUP BY grp""")
def interval_join_files(spark, sf_dir):
    """Files that each group's bounds meet: groups from one position to the whole chromosome."""
    groups = _read(spark, sf_dir, "part").groupBy(F.concat("p_brand", "p_size").alias("group")).agg(F.min("p_partkey").alias("start"), F.max("p_partkey").alias("stop")).withColumn("chrom", F.lit("1"))
    met = intervals.overlaps(groups, _region_files(spark, sf_dir), right_bounds=("region_start", "region_mid"))
    return met.groupBy("group").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"), F.max("region_start").alias("last_start"))


@query("SELECT DISTINCT l_partkey AS pos, '1:' || l_partkey || '_A/T' AS variant FROM lineitem WHERE l_partkey BETWEEN 40 AND 160")
def variant_list(spark, sf_dir):
    return list_variants(calls(spark, sf_dir, 40, 160), "genotype", "1", 40, 160).select("pos", "variant")


_IDS = "'chr' || (p_partkey % 22) || ':' || p_partkey || '_' || substr(p_brand, 1, 1) || '/' || p_size || '_x'"


@query(f"SELECT p_partkey AS id, (p_partkey % 22)::VARCHAR AS chrom, p_partkey AS pos, substr(p_brand, 1, 1) AS ref, p_size::VARCHAR AS alt, 'x' AS extra FROM part")
def variant_parse(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), V.parse(F.expr(_IDS)).alias("v")).select("id", "v.*")


@query("SELECT p_partkey AS pos, '1:' || p_partkey || ':A:T' AS colons, '1:' || p_partkey || '_A/T' AS epacts FROM part")
def variant_format_colons(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), V.colons(F.lit("1"), F.col("p_partkey"), F.lit("A"), F.lit("T")).alias("colons"))
    return p.withColumn("epacts", V.colons_to_epacts(F.col("colons")))


@query("""WITH l AS (SELECT c_custkey AS line, unnest([{'c': 'c_name', 'v': c_name}, {'c': 'c_custkey', 'v': c_custkey::VARCHAR}, {'c': 'c_acctbal', 'v': c_acctbal::VARCHAR}, {'c': 'mixed', 'v': CASE c_custkey % 3 WHEN 0 THEN 'NA' WHEN 1 THEN c_nationkey::VARCHAR || '.0' ELSE c_mktsegment END}]) AS s FROM customer),
k AS (SELECT s.c AS "column", line, CASE WHEN s.v IN ('NA', '.', '') THEN NULL WHEN TRY_CAST(s.v AS DOUBLE) = floor(TRY_CAST(s.v AS DOUBLE)) THEN 'INTEGER' WHEN TRY_CAST(s.v AS DOUBLE) IS NOT NULL THEN 'FLOAT' ELSE 'TEXT' END AS kind FROM l),
n AS (SELECT "column", kind, count(*) AS n, min(line) AS first FROM k WHERE kind IS NOT NULL GROUP BY ALL)
SELECT "column", kind FROM n QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, first) = 1""")
def type_inference(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    mixed = F.when(F.col("c_custkey") % 3 == 0, "NA").when(F.col("c_custkey") % 3 == 1, F.concat("c_nationkey", F.lit(".0"))).otherwise(F.col("c_mktsegment"))
    return phenotypes.infer_kinds(c.withColumn("line", F.col("c_custkey")).withColumn("mixed", mixed), ["c_name", "c_custkey", "c_acctbal", "mixed"], "line")


@query("SELECT p_partkey AS pos, round(p_retailprice / 7, 3) AS value FROM part")
def precision_round(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), V.rounded(F.col("p_retailprice") / 7, 3).alias("value"))


@query(f"""WITH {_ld_sql('rsquare', 0, 39)}, d AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS idx FROM s),
q AS (SELECT a.idx AS i, b.idx AS j, round(value, 6) AS value FROM v JOIN d a ON a.pos = pos1 JOIN d b ON b.pos = pos2),
o AS (SELECT idx, pos, coalesce(min(j), -2147483648) AS "offset" FROM d LEFT JOIN q ON i = idx GROUP BY idx, pos)
SELECT idx::INT AS idx, pos, "offset"::INT AS "offset", (j - "offset")::INT AS place, value FROM o LEFT JOIN q ON i = idx""")
def compact_matrix(spark, sf_dir):
    """Every value of the matrix with its row's offset and its place in the row."""
    out = render.compact(ld.region(calls(spark, sf_dir, 0, 39), _n(samples(spark, sf_dir)), "1", 0, 39), 6)
    rows = out.select(F.posexplode(F.arrays_zip("positions", "offsets", "correlations")).alias("idx", "v"))
    return rows.select("idx", F.col("v.positions").alias("pos"), F.col("v.offsets").alias("offset"), F.posexplode_outer("v.correlations").alias("place", "value"))


@query(f"WITH {_ld_sql('rsquare', 0, 39)} SELECT (row_number() OVER (ORDER BY pos1, pos2) - 1)::INT AS place, '1:' || pos1 || '_A/T' AS variant1, '1' AS chromosome1, pos1 AS position1, '1:' || pos2 || '_A/T' AS variant2, '1' AS chromosome2, pos2 AS position2, round(value, 4) AS correlation FROM v")
def classic_arrays(spark, sf_dir):
    """Every place of the seven arrays."""
    out = render.classic(ld.region(calls(spark, sf_dir, 0, 39), _n(samples(spark, sf_dir)), "1", 0, 39), 4)
    return out.select(F.posexplode(F.arrays_zip(*out.columns)).alias("place", "v")).select("place", "v.*")


@query("SELECT r_name AS subset, count(*) AS n_samples FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT 'ALL', count(*) FROM customer")
def catalog_populations(spark, sf_dir):
    s = samples(spark, sf_dir)
    named = s.join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    catalog = Catalog(spark)
    catalog.add("genotypes", {"id": "sales", "name": "parts that customers carry", "genome_build": "none"})
    catalog.add_subsets("sales", s.select(F.lit("ALL").alias("subset"), "sample"))
    catalog.add_subsets("sales", named.select(F.col("r_name").alias("subset"), "sample"))
    return catalog.populations("sales")


@query("SELECT DISTINCT (p_partkey % 22 + 1)::VARCHAR AS chrom FROM part JOIN lineitem ON l_partkey = p_partkey")
def chromosome_list(spark, sf_dir):
    return genotype.chromosomes(calls(spark, sf_dir).withColumn("chrom", (F.col("pos") % 22 + 1).cast("string")))


@query("SELECT p_partkey AS id, '1' AS chrom, p_partkey::VARCHAR AS pos, 'A' AS ref, 'T' AS alt FROM part WHERE p_partkey % 2 = 0")
def variant_parse_strict(spark, sf_dir):
    """Names of four tokens; with a fifth there is no variant."""
    name = F.concat(F.lit("1:"), F.col("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, F.lit("_A/T")).otherwise(F.lit("_A/T_more")))
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), V.strict_parts(name).alias("v")).where("v is not null")
    return rows.select("id", *[F.col("v")[i].alias(c) for i, c in enumerate(("chrom", "pos", "ref", "alt"))])


@query(f"WITH {_BLOCKS} SELECT pos, '1:' || pos || '_A/T' AS variant FROM v WHERE pos BETWEEN 40 AND 160")
def variant_list_blocks(spark, sf_dir):
    return list_variants(_block_inputs(spark, sf_dir)[0], "blocks", "1", 40, 160).select("pos", "variant")


@query("SELECT p_partkey AS pos, '1:' || p_partkey || '_A/T' AS variant FROM part WHERE p_partkey BETWEEN 40 AND 160")
def variant_list_scores(spark, sf_dir):
    return list_variants(_stated_scores(spark, sf_dir), "scores", "1", 40, 160).select("pos", "variant")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, for the files that the queries below write and read."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="alleloom-files-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def _written(lines: DataFrame, name: str, head: list[str], first: int | None = None) -> str:
    """``lines(k, value)`` in the order of ``k`` after a header (whose first line has ``first``, else what puts it before 0), as one text file."""
    spark = lines.sparkSession
    top = spark.createDataFrame([((-len(head) if first is None else first) + i, x) for i, x in enumerate(head)], "k long, value string")
    path = _folder(spark, name)
    top.unionByName(lines.select("k", "value")).orderBy("k").coalesce(1).select("value").write.text(path)
    return path


def _vcf(spark, sf_dir, start: int, stop: int) -> str:
    """A region's calls as a VCF: a line holds a variant's genotypes of all samples, as such files do."""
    names = samples(spark, sf_dir).agg(F.array_sort(F.collect_list("sample")).alias("ids"))  # a header's line
    n, places = _n(samples(spark, sf_dir)), names.select(F.posexplode("ids").alias("place", "sample"))
    genotype_ = F.when(F.col("dosage").isNull(), "./.").when(F.col("dosage") == 2, "1/1").otherwise("0/1")
    held = calls(spark, sf_dir, start, stop).join(places, "sample", "left").groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", genotype_.alias("g"))))).alias("e"))
    # between two that carry or miss it all samples are 0/0, so a line takes as many steps as it has calls
    before = lambda t: F.when(t > 0, F.get("e", t - 1)["place"]).otherwise(-1)
    called = F.array_join(F.transform("e", lambda x, t: F.concat(F.repeat(F.lit("0/0\t"), x["place"] - before(t) - 1), x["g"])), "\t")
    rest = lambda done: F.repeat(F.lit("\t0/0"), F.lit(n) - done)
    each = F.when(F.size("e") > 0, F.concat(called, rest(F.get("e", F.size("e") - 1)["place"] + 1))).otherwise(F.concat(F.lit("0/0"), rest(F.lit(1))))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), F.lit("A"), F.lit("T"), *[F.lit(".")] * 3, F.lit("GT"), each)
    head = names.select(F.lit(-1).cast("long").alias("k"), F.concat_ws("\t", F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"), F.col("ids").cast("array<string>")).alias("value"))
    return _written(held.select(F.col("pos").alias("k"), line.alias("value")).unionByName(head), "vcf", ["##fileformat=VCFv4.2"], first=-2)


@query(f"WITH {_calls_sql(0, 59)} SELECT '1:' || pos || '_A/T' AS variant, sample::VARCHAR AS sample, dosage FROM c WHERE pos BETWEEN 10 AND 49")
def vcf_file_calls(spark, sf_dir):
    """A region's calls from a VCF that was written from the tables."""
    return files.read_vcf(spark, _vcf(spark, sf_dir, 0, 59), "1", 10, 49).select("variant", "sample", "dosage")


@query("SELECT c_custkey::VARCHAR AS sample, (row_number() OVER (ORDER BY c_custkey) - 1)::INT AS idx FROM customer")
def vcf_file_samples(spark, sf_dir):
    return files.vcf_samples(spark, _vcf(spark, sf_dir, 0, 1)).select("sample", "idx")


@query("""SELECT p_brand AS "group", min(p_partkey) OVER (PARTITION BY p_brand) AS start, max(p_partkey) OVER (PARTITION BY p_brand) AS stop, '1:' || p_partkey || '_A/T' AS variant, p_partkey AS pos
FROM part QUALIFY min(p_partkey) OVER (PARTITION BY p_brand) <= 20 AND max(p_partkey) OVER (PARTITION BY p_brand) >= 10""")
def mask_file_members(spark, sf_dir):
    """Members of the groups that meet a region, from a mask file that was written from the tables."""
    rows = genes(spark, sf_dir).groupBy("group").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.concat_ws("\t", F.array_sort(F.collect_list("variant"))).alias("members"))
    path = _written(rows.select(F.col("start").alias("k"), F.concat_ws("\t", "group", F.lit("1"), F.col("start").cast("string"), F.col("stop").cast("string"), "members").alias("value")), "mask", [])
    return files.read_mask(spark, path, "1", 10, 20).select("group", "start", "stop", "variant", "pos")


@query("""SELECT p_partkey AS pos, '1:' || p_partkey || '_A/T' AS variant, CASE WHEN p_partkey % 3 = 0 THEN 0.25::DOUBLE ELSE (p_size / (2e0 * 500)) END AS alt_freq, 500::BIGINT AS n,
(p_partkey % 7 - 3)::DOUBLE AS score_stat, (p_size / 8e0)::DOUBLE AS sqrt_v, 0.5::DOUBLE AS pvalue FROM part""")
def score_file_rows(spark, sf_dir):
    """Scores from a file of one of the two formats that was written from the tables; its format is found from the header."""
    place = F.col("p_partkey").cast("string")
    fields = [F.lit("1"), place, F.lit("A"), F.lit("T"), F.lit("500:250:250"), F.when(F.col("p_partkey") % 3 == 0, "0.25").otherwise("NA"), F.col("p_size").cast("string"), *[F.lit("0")] * 5, (F.col("p_partkey") % 7 - 3).cast("string"), (F.col("p_size") / 8).cast("string"), F.lit("0"), F.lit("0.5")]
    path = _written(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat_ws("\t", *fields).alias("value")), "scores", ["##ProgramName=Rvtests", "CHROM\tPOS\tREF\tALT\tN_INFORMATIVE"])
    return files.read_scores(spark, path).select("pos", "variant", "alt_freq", "n", "score_stat", "sqrt_v", "pvalue")


@query("SELECT * FROM (VALUES ('name', 'TEXT'), ('nation', 'INTEGER'), ('balance', 'FLOAT')) t(\"column\", kind) WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal <> floor(c_acctbal))")
def phenotype_file_kinds(spark, sf_dir):
    """Kinds of the columns of a phenotype table that was written from the customers."""
    line = F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 10 == 0, "NA").otherwise(F.col("c_acctbal").cast("string")))
    path = _written(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), line.alias("value")), "phenotypes", ["id\tname\tnation\tbalance"])
    return phenotypes.infer_kinds(files.read_tab(spark, path), ["name", "nation", "balance"], "line")


@query(f"WITH {_ld_sql('rsquare', 0, 149)} SELECT pos1, pos2, round(value, 8) AS value, {_morton_sql('pos1 // 20', 'pos2 // 20')} AS cell FROM v WHERE pos1 BETWEEN 45 AND 130 AND pos2 BETWEEN 45 AND 130 ORDER BY cell, pos1, pos2 LIMIT 900")
def ld_page_stored(spark, sf_dir):
    """A region's page from stored cells, some of which a page of an overlapping region has stored before."""
    store, rows, n = CellStore(spark, _folder(spark, "cells")), calls(spark, sf_dir, 0, 149), _n(samples(spark, sf_dir))
    kept = {"store": store, "dataset": "parts", "subset": "ALL"}
    paging.region_page(rows, n, "1", 0, 70, "rsquare", 20, 500, **kept).count()
    return paging.region_page(rows, n, "1", 45, 130, "rsquare", 20, 900, **kept).select("pos1", "pos2", F.round("value", 8).alias("value"), "cell")
