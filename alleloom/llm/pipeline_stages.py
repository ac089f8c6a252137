"""Stages that turn documents into documents, each by one operator.

For all stages: a stage judges a text, so rows are told apart by the 64-bit hash of theirs (``_key``), not by ids, which may
be null or repeated: a bad text drops its own rows alone. A null text is judged like an empty one. Texts
are read whole, however long. Other columns of any name are carried along as they are, and no documents give no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import classifier, decontamination, jaccard, packing, suffix_dedup
from .common import arrow_map, table

#: Columns that the stages add for a while; documents have none of these names.
KEY, CUT = "_stage_text_key", "_stage_cut_text"


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"])


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Documents whose text key is not among ``bad(doc_id)``."""
    keys = bad.select(F.col("doc_id").alias(KEY)).distinct()
    return docs.join(keys, _key(docs) == keys[KEY], "left_anti")


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good; trained on the labels beside the tables. All rows of a repeated text go or stay together."""
    trees = classifier.train(docs, table(spark, sf_dir, "labels"))
    return _without(docs, classifier.score(docs.withColumn(KEY, _key(docs)), trees, id_col=KEY).where("predicted = 0"))


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard similarity 0.8 of five-word shingles) one document stays.

    Pairs meet by the SimHash operator's pigeonring chains and, beyond its two bits, in MinHash bands; all are verified. The one that
    stays has the least id, null ids last, then the least hash of its text; repeated rows count once, and blank texts are one group.
    """
    groups = jaccard.near_duplicates(docs)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one"))
    first = first.select(F.col("one.doc_id").alias(CUT), F.col("one.text_key").alias(KEY))
    same = docs["doc_id"].eqNullSafe(first[CUT]) & (_key(docs) == first[KEY])
    return docs.dropDuplicates(["doc_id", "text"]).join(first, same, "left_semi")


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings; characters cut in two go, and so do texts with nothing left.

    ``n_chars`` is counted anew for changed texts, if there is such a column. Texts that lose nothing stay as they are, blank and null ones as well.
    """

    def make(batch: pa.RecordBatch) -> dict:
        rows = [suffix_dedup.remaining(t or b"", s) for t, s in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True)]
        return {KEY: batch["doc_id"], CUT: pa.array([r[0].decode("utf-8", "ignore") if r[1] else None for r in rows], pa.string())}

    spans = suffix_dedup.with_spans(docs.withColumn(KEY, _key(docs)), id_col=KEY).where("spans is not null")
    changed = arrow_map(spans, make, f"{KEY} long, {CUT} string").dropDuplicates([KEY])
    new = {"text": F.coalesce(F.col(CUT), docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(CUT).isNotNull(), F.length(CUT).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    out = docs.join(changed, _key(docs) == changed[KEY], "left").where(F.col(CUT).isNull() | (F.trim(CUT) != ""))
    return out.select(*[new[c].alias(c) if c in new else docs[f"`{c}`"] for c in docs.columns])


def drop_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; all rows of a repeated text go or stay together."""
    return _without(docs, decontamination.contaminated(docs.withColumn(KEY, _key(docs)), table(spark, sf_dir, "benchmark"), id_col=KEY))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left; a row for each document, those without an id or text too."""
    return packing.pack_documents(docs)
