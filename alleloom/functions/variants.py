"""Variant identifiers, allele arithmetic and p-values as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

#: Fixed value: chromosome (an optional "chr" is dropped), position, alleles, anything more.
VARIANT = r"^(?:chr)?([^:]+):(\d+)[_:]([^/:_]+)[/:]([^_:]+)(?:[_:](.*))?$"
#: Coefficients of a Chebyshev fit of erfc, by power of t.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Fixed values: (shift, mask) steps that spread 32 bits over 64.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def parse(variant: Column) -> Column:
    """Struct of chrom, pos, ref, alt and extra; null where the text is no variant."""
    part = [F.regexp_extract(variant, VARIANT, i) for i in range(1, 6)]
    return F.when(variant.rlike(VARIANT), F.struct(part[0].alias("chrom"), part[1].cast("bigint").alias("pos"), part[2].alias("ref"), part[3].alias("alt"), F.nullif(part[4], F.lit("")).alias("extra")))


def identifier(variant: str) -> tuple[str, int, str, str]:
    """Chromosome, position and alleles of a variant that a caller names, in either notation; anything else is an error."""
    found = re.match(VARIANT, variant or "")
    if not found:
        raise QueryError("not a variant", variant)
    return found[1], int(found[2]), found[3], found[4]


def identifier_parts(variant: Column) -> list[Column]:
    """Chromosome, position and alleles of a name in either notation."""
    return [F.regexp_extract(variant, VARIANT, i) for i in range(1, 5)]


def strict_parts(variant: Column) -> Column:
    """The four tokens between ``:``, ``_`` and ``/``; null unless there are four."""
    parts = F.split(variant, "[:_/]")
    return F.when(F.size(parts) == 4, parts)


def epacts(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat(chrom, F.lit(":"), pos.cast("string"), F.lit("_"), ref, F.lit("/"), alt)


def colons(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), ref, alt)


def colons_to_epacts(variant: Column) -> Column:
    """``chrom:pos:ref:alt`` in the other notation; anything else as it is."""
    return F.regexp_replace(variant, r"^([^:]+):(\d+):([^:]+):([^:]+)$", "$1:$2_$3/$4")


def segment(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)).cast("bigint")


def morton(i: Column, j: Column) -> Column:
    """Place of cell (i, j) on the Z-order curve; i gives the lower of each two bits."""

    def spread(x: Column) -> Column:
        x = x.cast("bigint")
        for shift, mask in SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return spread(i).bitwiseOR(F.shiftleft(spread(j), 1))


def unmorton(code: Column) -> tuple[Column, Column]:
    """The cell of a place on the curve."""

    def gather(x: Column) -> Column:
        x = x.bitwiseAND(F.lit(SPREAD[-1][1]))
        for (shift, _), mask in zip(reversed(SPREAD), [m for _, m in reversed(SPREAD[:-1])] + [(1 << 32) - 1], strict=True):
            x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return gather(code), gather(F.shiftrightunsigned(code, 1))


def minor(af: Column) -> Column:
    return F.least(af, F.lit(1e0) - af)


def leading_number(text: Column) -> Column:
    """The number that a text begins with (binary traits hold ``all:case:control``); null if none."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def alt_frequency(af: Column, alt_count: Column, n: Column) -> Column:
    """The stated frequency, else allele count over chromosomes."""
    return F.coalesce(leading_number(af), F.try_divide(leading_number(alt_count), F.lit(2e0) * leading_number(n)))


def two_sided_p(z: Column) -> Column:
    """Twice the normal tail beyond |z|; relative accuracy about 1e-7 in the tail as well."""
    x = F.abs(z) / F.sqrt(F.lit(2e0))
    t = F.lit(1e0) / (F.lit(1e0) + F.lit(0.5e0) * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[1:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + F.lit(ERFC[0]) + t * poly)


def rounded_fast(value: Column, digits: int) -> Column:
    """``F.round`` of a double, the same to the last bit, without a decimal for each row.

    The nearest whole number of 10 ** -digits, divided in doubles, is what the rounded decimal gives as a double. Only near a tie, where
    the product's own rounding could tell, and for very large values, the decimal is made.
    """
    scaled = value * F.lit(10.0**digits)
    whole = F.rint(scaled)
    return F.when((F.abs(scaled) < 1e12) & (F.abs(scaled - whole) < 0.499), whole / F.lit(10.0**digits) + F.lit(0e0)).otherwise(F.round(value, digits))


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero; 0 digits leave the value as it is, NaN becomes null."""
    value = F.when(~F.isnan(value), value)
    return F.round(value, digits) if digits > 0 else value
