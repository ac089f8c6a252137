"""From raw documents to packed batches; each stage applies one operator to all that the one before kept."""

from __future__ import annotations

from alleloom.llm import pipeline_stages as stages
from alleloom.llm.common import cut, drop_tables, noted, table

STAGES = [
    ("quality_classifier", stages.keep_quality),
    ("simhash_near_dedup", stages.keep_one_of_each),
    ("suffix_array_dedup", stages.cut_repeats),
    ("benchmark_decontamination", stages.drop_benchmark),
    ("packing", stages.pack),
]

#: The classifier and the suffix order can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order; each result is a Parquet table in the shared folder that the next one reads.

    When a stage's result is there, what it wrote on its way and what it was given are deleted.
    """
    docs, given = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with noted() as made:
            docs = cut(stage(spark, docs, sf_dir), name)
        drop_tables(spark, given + made[:-1])
        given = made[-1:]
    return docs
