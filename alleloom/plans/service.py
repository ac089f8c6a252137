"""A genotype dataset with its samples: correlation, score and listing requests answered as functions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame

from ..errors import QueryError
from ..operators import bitset, genotype, ld, score
from ..sources import files
from . import paging, requests
from .cellstore import CellStore


@dataclass(frozen=True)
class Genotypes:
    """``calls`` of haplotypes (or of haploid samples) and ``samples(sample)``, all of those in the files or a population of them.

    The numbers of haplotypes and samples are counted once, where they are first needed.
    """

    calls: DataFrame
    samples: DataFrame
    segment: int = requests.SEGMENT_SIZE
    store: CellStore | None = None
    dataset: str = ""
    subset: str = "ALL"

    @classmethod
    def open(cls, spark, paths: list[str]) -> Genotypes:
        """Text VCFs of the same samples; others are an error."""
        return cls(files.read_vcf(spark, paths, haplotypes=True), files.same_samples(spark, paths))

    def kept(self, store: CellStore | None, dataset: str) -> Genotypes:
        """The same with pages of regions kept in a store under the dataset's name; without a store nothing is kept or read."""
        return replace(self, store=store, dataset=dataset)

    def of(self, population: DataFrame, name: str | None = None) -> Genotypes:
        """The dataset restricted to a population; samples that the files lack are passed over. Only results of a named population are kept."""
        some = genotype.of_samples(self.samples, population)
        return replace(self, calls=genotype.of_samples(self.calls, some), samples=some, store=self.store if name else None, subset=name or "")

    @cached_property
    def n_samples(self) -> int:
        return genotype.size(self.samples)

    def _counted(self, correlation: str) -> tuple[DataFrame, int]:
        """The matrix that a correlation is over, and its number of rows: counts of samples for covariances, haplotypes else."""
        if "hap" not in self.calls.columns:
            return self.calls, self.n_samples
        return (genotype.as_samples(self.calls), self.n_samples) if correlation == "cov" else (self.calls, 2 * self.n_samples)

    @cached_property
    def places(self) -> DataFrame:
        """Where each haplotype's bit is; ``cut`` or store it to pack many regions."""
        return bitset.numbered(self.samples, 2 * self.n_samples)

    def packed_ld(self, chrom: str, start: int, stop: int, correlation: str, diagonal: bool = False) -> DataFrame:
        """All pairs of a region of common variants, from haplotypes packed into words."""
        requests.region_request(chrom, start, stop, correlation)
        bits = bitset.packed(genotype.in_region(self.calls, chrom, start, stop), self.places)
        return bitset.region_pairs(bits, 2 * self.n_samples, correlation, diagonal)

    def region_ld(self, chrom: str, start: int, stop: int, correlation: str, limit: int = requests.PAGE_LIMIT, after: paging.Cursor | None = None, diagonal: bool = False) -> DataFrame:
        """A page of a region's pairs in Z-order; an unknown chromosome or an empty population gives no rows."""
        asked = requests.region_request(chrom, start, stop, correlation, limit)
        calls, n = self._counted(correlation)
        return paging.region_page(calls, n, chrom, start, stop, correlation, self.segment, asked["limit"], after, diagonal, self.store, self.dataset, self.subset, dense=None)

    def variant_ld(self, variant: str, chrom: str, start: int, stop: int, correlation: str, limit: int = requests.PAGE_LIMIT, after: paging.Cursor | None = None) -> DataFrame:
        """A page of one variant against a region."""
        asked = requests.variant_request(variant, chrom, start, stop, correlation, limit)
        calls, n = self._counted(correlation)
        return paging.variant_page(calls, n, asked["variant"], chrom, start, stop, correlation, self.segment, asked["limit"], after)

    def scores(self, phenotype: DataFrame, chrom: str, start: int, stop: int, limit: int = requests.PAGE_LIMIT, after: paging.Cursor | None = None) -> DataFrame:
        """A page of score statistics over the samples that have a phenotype."""
        requests.region_request(chrom, start, stop, "cov", limit)
        inside = genotype.in_region(self._counted("cov")[0], chrom, start, stop)
        have = genotype.of_samples(phenotype, self.samples)
        return paging.score_page(score.score_statistics(inside, have), self.segment, limit, after)

    def frequencies(self, chrom: str, start: int, stop: int) -> DataFrame:
        return genotype.frequencies(genotype.in_region(self._counted("cov")[0], chrom, start, stop), self.n_samples)

    def chromosomes(self) -> DataFrame:
        return genotype.chromosomes(self.calls)

    def pairs(self, first: DataFrame, second: DataFrame, correlation: str) -> DataFrame:
        """Pairs between two listings of variants, in either order (``chrom, pos, variant``)."""
        if correlation not in ld.METRICS:
            raise QueryError(f"unknown correlation {correlation}")
        calls, n = self._counted(correlation)
        both = first.select(*ld.VARIANT).unionByName(second.select(*ld.VARIANT)).distinct()
        rows = ld.region_pairs(calls.join(both, list(ld.VARIANT), "left_semi"), n, correlation, True)
        kept = [listing.select(*ld.VARIANT).distinct().withColumn(f"in{k}", ld.F.lit(True)) for k, listing in ((1, first), (2, second))]
        for i in ("1", "2"):
            for k, listing in enumerate(kept, 1):
                side = listing.select("chrom", ld.F.col("pos").alias(f"pos{i}"), ld.F.col("variant").alias(f"variant{i}"), ld.F.col(f"in{k}").alias(f"in{k}{i}"))
                rows = rows.join(side, ["chrom", f"pos{i}", f"variant{i}"], "left")
        return rows.where("(in11 and in22) or (in21 and in12)").select("chrom", "pos1", "variant1", "pos2", "variant2", "value")
