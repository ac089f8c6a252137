"""Optimal length buckets and token-budget batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, shared_path
from .ranking import each_copy, ranked, ring_key
from .token_output import read_lengths, write_shards


def boundaries(histogram: Sequence[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds that minimise padding; ``histogram``: (length, count), ascending.

    cost(i, j) = length j times the count of lengths i to j, less the sum of them. The best cost for k
    buckets up to length j is the least over i of that for k - 1 before i, plus cost(i, j). For a
    fixed i that is a line in the length j, and slopes fall with i, so the least is read from the lines'
    lower envelope as j grows: k passes over the histogram, in whole numbers. Ties take the earliest i.
    Fewer lengths than buckets: each has its own.
    """
    if not histogram:
        return []
    top = [length for length, _ in histogram]
    count, total = [0], [0]
    for length, n in histogram:
        count.append(count[-1] + n)
        total.append(total[-1] + length * n)
    every = range(len(top))
    best = [top[j] * count[j + 1] - total[j + 1] for j in every]
    came = []
    for _ in range(1, min(buckets, len(top))):
        before = [0, *best[:-1]]
        lines: list[tuple[int, int, int]] = []  # slope, height, i
        at, best, step = 0, [], []
        for j in every:
            slope, height = -count[j], before[j] + total[j]
            while len(lines) > 1:
                (m1, b1, _), (m2, b2, _) = lines[-2:]
                if (height - b1) * (m1 - m2) > (b2 - b1) * (m1 - slope):
                    break
                lines.pop()
            lines.append((slope, height, j))
            at = min(at, len(lines) - 1)
            x = top[j]
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] < lines[at][0] * x + lines[at][1]:
                at += 1
            best.append(lines[at][0] * x + lines[at][1] + x * count[j + 1] - total[j + 1])
            step.append(lines[at][2])
        came.append(step)
    cuts, j = [len(top) - 1], len(top) - 1
    for step in reversed(came):
        j = step[j] - 1
        if j < 0:
            break
        cuts.append(j)
    return [top[j] for j in reversed(cuts)]


def word_count(text):
    """Words and one end token; a null text has only the end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1).cast("long")


def pack(rows: DataFrame, buckets: int = 8, batch_tokens: int = 65_536, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """``doc_id, n_tokens, bucket, boundary, batch, place, padding``: one row per input row.

    The histogram of all lengths decides the boundaries on the driver: a row for each different
    length, as many as the longest text has tokens at most. In a bucket, texts come in the order of the MD5 of their ids; a batch has as many as
    the budget holds at the bucket's boundary, one at least. Nothing is dropped: a text
    longer than the budget is a batch of its own bucket's width. Null lengths count as 0 and
    null ids are kept. Repeated rows count each, and are ranked as one row with a number. No rows give no rows.
    """
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.greatest(F.col(f"`{length_col}`").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    # written once, so that texts are read once
    different = cut(rows.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies")), "lengths")
    counted = different.groupBy("n_tokens").agg(F.sum("copies").alias("n"))
    tops = boundaries(sorted((r["n_tokens"], r["n"]) for r in counted.collect()), buckets) or [0]
    bucket = F.lit(len(tops) - 1)
    bound = F.lit(tops[-1])
    for i in range(len(tops) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= tops[i], F.lit(i)).otherwise(bucket)
        bound = F.when(F.col("n_tokens") <= tops[i], F.lit(tops[i])).otherwise(bound)
    digest, place = ring_key("doc_id")
    keyed = different.select("*", bucket.cast("int").alias("bucket"), bound.cast("long").alias("boundary"), digest.alias("digest"), place.alias("ring"))
    size = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest("boundary", F.lit(1))), F.lit(1)).cast("long")
    return each_copy(ranked(keyed, ["bucket"], "ring", ["digest", "doc_id", "n_tokens"])).select(
        "doc_id", "n_tokens", "bucket", "boundary", F.floor(F.col("rank") / size).cast("long").alias("batch"), (F.col("rank") % size).cast("long").alias("place"), (F.col("boundary") - F.col("n_tokens")).alias("padding")
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``pack`` by word counts; only ids and counts leave the scan."""
    return pack(docs.select(F.col(f"`{id_col}`").alias("doc_id"), word_count(F.col(f"`{text_col}`").cast("string")).alias("n_tokens")), **how)


def pack_shards(spark, path: str, **how) -> DataFrame:
    """``pack`` of the documents in token files (``token_output.write_shards``) by their numbers of ids, end included.

    Rows without an id or a text are in the files too, so they are packed like others. No files' rows: no rows.
    """
    return pack(read_lengths(spark, path), **how)


def pack_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Writes the documents' token files to the shared folder, then packs by what these hold."""
    path = write_shards(docs, shared_path(docs.sparkSession, "token-shards"), tokenizer, id_col=id_col, text_col=text_col)
    return pack_shards(docs.sparkSession, path, **how)
