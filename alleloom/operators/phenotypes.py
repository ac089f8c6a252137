"""Phenotype columns: missing values, types, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a missing value.
MISSING = ("NA", ".", "")
MISSING_CATEGORY = (*MISSING, "0", "-9")


def value_or_null(text: Column, pedigree_category: bool = False) -> Column:
    return F.when(~F.trim(text).isin(*(MISSING_CATEGORY if pedigree_category else MISSING)), F.trim(text))


def number(text: Column) -> Column:
    """The value as a number; a text that is neither a number nor missing is an error."""
    v = value_or_null(text)
    return F.when(v.isNull(), None).otherwise(F.coalesce(v.try_cast("double"), F.raise_error(F.concat(F.lit("not a number: "), v)).cast("double")))


def encode_by_appearance(rows: DataFrame, column: str, line: str) -> DataFrame:
    """``(level, code)``: levels by their first line; an integer keeps its value, another text gets the largest code so far plus one (0 at first)."""
    from pyspark.sql import Window

    first = rows.select(value_or_null(F.col(column)).alias("level"), F.col(line).alias("line")).dropna().groupBy("level").agg(F.min("line").alias("line"))
    # a row for each level; a text's code is its count among texts, plus what an integer before it was ahead of that count
    so_far = Window.orderBy("line", "level").rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(F.col("level").rlike("^[+-]?[0-9]+$"), F.col("level").try_cast("bigint"))
    counted = first.select("level", number.alias("number"), F.sum(number.isNull().cast("bigint")).over(so_far).alias("texts"), "line")
    ahead = F.max(F.col("number") - F.col("texts")).over(so_far)
    return counted.select("level", F.coalesce("number", F.col("texts") + F.greatest(F.lit(-1), ahead)).alias("code"))


def encode_pedigree(text: Column) -> Column:
    """Affection status: 1 is 0, 2 is 1, missing is null, more is an error."""
    v = value_or_null(text, True)
    return F.when(v == "1", 0e0).when(v == "2", 1e0).when(v.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not a status: "), v)).cast("double"))


def kind(text: Column) -> Column:
    """A value's kind: INTEGER (3.0 as well), FLOAT or TEXT; null where missing."""
    v = value_or_null(text)
    x = v.try_cast("double")
    return F.when(v.isNull(), None).when(x == F.floor(x), "INTEGER").when(x.isNotNull(), "FLOAT").otherwise("TEXT")


def infer_kinds(rows: DataFrame, columns: list[str], line: str) -> DataFrame:
    """``(column, kind)``: each column's most common kind; of equals the one that comes first. One aggregation."""
    long = rows.select(F.col(line).alias("line"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), kind(F.col(c).cast("string")).alias("kind")) for c in columns])))
    counts = long.where("kind is not null").groupBy("column", "kind").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    return counts.groupBy("column").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("first"))).alias("kind"))
