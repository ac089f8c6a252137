"""What each of five filters removes, in every order: survivors of all subsets of filters from one SQL CUBE."""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import arrow_map

#: The filters; filter i fails a document where bit i is set.
LETTERS = "ABCDE"
ALL = (1 << len(LETTERS)) - 1
COPY = LETTERS.index("E")
SYMBOLS = b"#$%&*|"
UPPER, CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """The bits of the filters A to D, which look at a text alone."""
    words = text.split()
    n = len(words)
    upper, points = len(text) - len(text.translate(None, UPPER)), len(text.translate(None, CONTINUED))
    failed = (n < 200, 100 * len(set(words)) < 50 * n, 100 * upper > 2 * points, any(c in text for c in SYMBOLS))
    return sum(1 << i for i, f in enumerate(failed) if f)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, failed, text_key``: bits of A to D and the SHA-256 of the text; one row per input row."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))

    def make(batch: pa.RecordBatch) -> dict:
        texts = batch["text"].to_pylist()
        return {"doc_id": batch["doc_id"], "part": batch["part"], "failed": pa.array(map(failures, texts), pa.int32()), "text_key": pa.array((hashlib.sha256(t).digest() for t in texts), pa.binary())}

    return arrow_map(rows, make, "doc_id long, part string, failed int, text_key binary")


def failure_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, n, good, toxic``: documents by the bits of all five filters, at most 32 rows a part.

    ``rows(doc_id, part, failed, text_key)`` have the bits of A to D. E fails a document whose text a smaller id has, wherever
    that document is. Rows of one text are counted before they meet, by what else tells them apart,
    so a text that a third of all rows have sends a few rows for each part.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    each = rows.groupBy("text_key", "part", "failed", "doc_id").agg(F.count("*").alias("n"))
    each = each.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    named = F.col("doc_id").isNotNull()
    groups = each.groupBy("text_key", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unnamed"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"))
    copied = groups.groupBy("text_key").agg(F.min("first.doc_id").alias("least"), F.sum("n").alias("copies")).where("copies > 1 and least is not null")
    met = groups.join(copied.select("text_key", "least"), "text_key", "left")
    passed = F.when(F.col("least").isNull(), F.col("n")).otherwise(F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0))
    both = F.array(F.struct(F.col("failed"), F.col("passed").alias("n")), F.struct(F.col("failed").bitwiseOR(F.lit(1 << COPY)).alias("failed"), (F.col("n") - F.col("passed")).alias("n")))
    split = met.withColumn("passed", passed).select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.failed", "x.n").where("n > 0")
    none = F.lit(0).cast("long")
    return split.groupBy("part", "failed").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(none)).alias(c) for c in ("good", "toxic")])


def survivors(counts: DataFrame) -> DataFrame:
    """``part, subset, kept, good, toxic``: documents that no filter of the subset (a mask) fails, for each of the 32 subsets.

    One CUBE over the five flags and the part: of the grouping set of a subset's flags, the row with all of them false.
    It is over counts of flags, so what it expands are at most 32 rows a part. Parts without survivors have zeros.
    """
    flags = counts.select("part", "n", "good", "toxic", *[(F.col("failed").bitwiseAND(F.lit(1 << i)) != 0).alias(f"fails_{c}") for i, c in enumerate(LETTERS)])
    names = [f"fails_{c}" for c in LETTERS]
    cube = flags.cube("part", *names).agg(F.sum("n").alias("kept"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.grouping("part").alias("all_parts"), *[F.grouping(c).alias(f"all_{c}") for c in names])
    chosen = sum(((F.lit(1) - F.col(f"all_{c}")) * F.lit(1 << i) for i, c in enumerate(names)), F.lit(0))
    passed = cube.where("all_parts = 0").where(~F.coalesce(F.greatest(*names), F.lit(False))).select("part", chosen.cast("int").alias("subset"), "kept", "good", "toxic")
    grid = counts.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    return grid.join(passed, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "good", "toxic")])


def steps(subsets: DataFrame) -> DataFrame:
    """``part, subset, bit`` and what the filter ``bit`` removes after the subset's: pairs of subsets that differ by one filter."""
    more = F.explode(F.array(*[F.lit(1 << i) for i in range(len(LETTERS))]))
    before = subsets.select("part", "subset", "kept", "good", "toxic", more.alias("bit")).where(F.col("subset").bitwiseAND(F.col("bit")) == 0).withColumn("next", F.col("subset").bitwiseOR(F.col("bit")))
    after = subsets.select("part", F.col("subset").alias("next"), *[F.col(c).alias(f"{c}_after") for c in ("kept", "good", "toxic")])
    pairs = before.join(after, ["part", "next"])
    return pairs.select("part", "subset", "bit", F.col("kept_after").alias("kept"), (F.col("kept") - F.col("kept_after")).alias("removed"), (F.col("good") - F.col("good_after")).alias("good_lost"), (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"))


def orders(spark) -> DataFrame:
    """``filter_order, step, subset, bit``: the 600 steps of the 120 orders."""
    rows = []
    for order in permutations(LETTERS):
        done = 0
        for step, c in enumerate(order, 1):
            bit = 1 << LETTERS.index(c)
            rows.append(("".join(order), step, done, bit))
            done |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, subset int, bit int")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A null text is empty, a null part the empty string; texts are read whole. E fails no document
    without an id, nor the rows of a text's least id, repeated rows included. Of several labels of one id any that is 1 counts; documents
    without a label are neither good nor toxic. A part is a value of ``part_col``, so no documents give no rows. Other columns are not read.
    """
    each = steps(survivors(failure_counts(judged(docs, id_col, text_col, part_col), labels)))
    size = F.bit_count("subset")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(LETTERS) - 1 - k)) for k in range(len(LETTERS))]), size + 1)
    only = F.col("subset") == F.lit(ALL) - F.col("bit")
    filters = each.groupBy("part", "bit").agg(F.sum(weight * F.col("removed")).alias("shapley"), F.max(F.when(F.col("subset") == 0, F.col("removed"))).alias("failing"), F.max(F.when(only, F.col("removed"))).alias("unique_fails"))
    # the orders are 600 rows, whatever the input
    rows = each.join(filters, ["part", "bit"]).join(F.broadcast(orders(docs.sparkSession)), ["subset", "bit"])
    return rows.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
