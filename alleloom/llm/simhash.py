"""SimHash near-duplicates with pigeonring filtering of candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, documents
from .components import components

BITS = 64
#: Ring segments of 16 bits, for links at 2 or fewer differing bits.
SEGMENTS = 4
SPAN = BITS // SEGMENTS


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles, as a signed integer; no words: zero."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        values = np.array([digest(line, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        values = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    return majority(values)


def majority(values: np.ndarray) -> int:
    """A bit is 1 where over half of the unsigned 64-bit values have it; as a signed integer, zero of none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(values)).view(">u8")[0]
    return int(bits.astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp long)``: one row per document, null and empty texts with fingerprint 0."""

    def make(batch: pa.RecordBatch) -> dict:
        fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch["text"]), np.int64, batch.num_rows)
        return {"doc_id": batch["doc_id"], "fp": pa.array(fps)}

    return arrow_map(documents(docs, id_col, text_col), make, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SPAN * (i % SEGMENTS)).bitwiseAND(F.lit((1 << SPAN) - 1))


def _chain(a: Column, b: Column, max_diff: int) -> Column:
    """Some start segment whose cumulative differences over 1, 2, ... segments stay in budget."""
    diff = a.bitwiseXOR(b)
    some = F.lit(False)
    for i in range(SEGMENTS):
        total, held = F.lit(0), F.lit(True)
        for n in range(1, SEGMENTS):
            total = total + F.bit_count(_segment(diff, i + n - 1))
            held = held & (total <= max_diff * n // SEGMENTS)
        some = some | held
    return some


def links(nodes: DataFrame, max_diff: int = 2, bucket_limit: int = 64) -> DataFrame:
    """``(u, v)``: edges whose components are those of all fingerprint pairs at ``max_diff`` or fewer bits.

    ``nodes(fp)`` are distinct. Four segments on a ring and two differing bits: by the
    pigeonring principle some chain of three segments differs in 0, then at most 1, then at
    most 1 bits, so its first segment and one of the next two are equal. Those two segments
    are the index key (six keys of 32 bits a fingerprint). Buckets of up to ``bucket_limit``
    fingerprints are joined, checked against the chain budgets, then by the full distance.
    Fuller buckets go another exact way, without pairs: each of their fingerprints meets, under
    every value one bit away, the others of that value (65 at most, all within two bits).
    """
    if not 0 < max_diff <= 2:
        raise ValueError("max_diff is 1 or 2")
    pairs = [(i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]
    fp = F.col("fp")
    keys = F.array(*[F.shiftleft(_segment(fp, i), SPAN).bitwiseOR(_segment(fp, j)).bitwiseOR(F.lit(k << 2 * SPAN)) for k, (i, j) in enumerate(pairs)])
    banded = nodes.select("fp", F.explode(keys).alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = cut(banded.join(sizes, "key"))
    small = crowded.where(F.col("n") <= bucket_limit)
    near = (
        small.select("key", F.col("fp").alias("u"))
        .join(small.select("key", F.col("fp").alias("v")), "key")
        .where("u < v")
        .where(_chain(F.col("u"), F.col("v"), max_diff))
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_diff)
        .select("u", "v")
    )
    full = crowded.where(F.col("n") > bucket_limit).select("fp").distinct()
    if max_diff == 1:
        star = full.select("fp", F.explode(_around(fp)).alias("x")).join(full.select(F.col("fp").alias("x")), "x", "left_semi").select(F.col("fp").alias("u"), F.col("x").alias("v"))
    else:
        met = full.select("fp", F.explode(_around(fp)).alias("x")).groupBy("x").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        star = met.select(F.array_min("all").alias("u"), F.explode("all").alias("v"))
    return near.unionByName(star.where("u <> v")).distinct()


def _around(fp: Column) -> Column:
    """The fingerprint and the 64 values one bit away."""
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_diff: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (least doc_id reachable).

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles keep repeats; fewer words than
    a shingle are one shingle; null, empty and blank texts have fingerprint zero and link like
    any other. Equal fingerprints collapse into one node before the index is built, so copies
    never make pairs. A null id keeps its row, and is never a component's least id while another
    id is in it. Repeated rows each give a row. No documents give no rows.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), max_diff))
    ids = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = ids.join(ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
