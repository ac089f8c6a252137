"""Requests are checked before anything is planned."""

from __future__ import annotations

from ..errors import QueryError
from ..functions.variants import identifier
from ..operators.ld import METRICS

#: The service's limits.
PAGE_LIMIT, REGION_LIMIT, GROUP_LIMIT, SEGMENT_SIZE = 100_000, 4_000_000, 1_000_000, 1_000
FILTER_FIELDS, FILTER_OPS = ("maf", "pvalue"), ("gte", "lte")


def region_request(chrom: str, start: int, stop: int, correlation: str, limit: int = PAGE_LIMIT, **unknown) -> dict:
    """A region request with its page size clamped."""
    if unknown:
        raise QueryError(f"unknown parameters: {', '.join(sorted(unknown))}")
    if start < 0 or stop <= start:
        raise QueryError("stop must be greater than start")
    if stop - start > REGION_LIMIT:
        raise QueryError(f"the region is longer than {REGION_LIMIT}")
    if correlation not in METRICS:
        raise QueryError(f"unknown correlation {correlation}")
    if limit <= 0:
        raise QueryError("limit must be positive")
    return {"chrom": chrom, "start": start, "stop": stop, "correlation": correlation, "limit": min(limit, PAGE_LIMIT)}


def variant_request(variant: str, chrom: str, start: int, stop: int, correlation: str, limit: int = PAGE_LIMIT, **unknown) -> dict:
    """A request for one variant against a region; the name must be a variant's, in either notation."""
    at, pos, ref, alt = identifier(variant)
    return region_request(chrom, start, stop, correlation, limit, **unknown) | {"variant": f"{at}:{pos}_{ref}/{alt}"}


def listing_request(chrom: str, start: int, stop: int, genotype: str | None = None, summary: str | None = None, **unknown) -> dict:
    """A request for the variants of a region of exactly one dataset."""
    if bool(genotype) == bool(summary):
        raise QueryError("give either a genotype dataset or summary statistics")
    checked = region_request(chrom, start, stop, "r", **unknown)
    return {k: checked[k] for k in ("chrom", "start", "stop")} | {"kind": "genotype" if genotype else "scores", "dataset": genotype or summary}


def aggregation_request(masks: list | None = None, mask_definitions: list | None = None, genotype: str | None = None, phenotype: str | None = None, summary: str | None = None, filters: list | None = None, groups: list | None = None) -> None:
    """Either masks or definitions, either genotypes with a phenotype or summary statistics; filters known; groups not too wide."""
    if bool(masks) == bool(mask_definitions):
        raise QueryError("give either masks or mask definitions")
    if bool(genotype and phenotype) == bool(summary):
        raise QueryError("give either genotypes and a phenotype, or summary statistics")
    for f in filters or []:
        if f.get("field") not in FILTER_FIELDS or f.get("op") not in FILTER_OPS or not isinstance(f.get("value"), int | float):
            raise QueryError(f"unsupported filter {f}")
    for start, stop in groups or []:
        if stop < start or stop - start > GROUP_LIMIT:
            raise QueryError(f"a group must be at most {GROUP_LIMIT} wide")
