"""Quality rules in a bitmask ledger: measured once, then judged by any policy."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, shared_path

SPACE = b" \t\n\x0b\x0c\r"
CONTINUED = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
#: Neither letters, white space nor parts of characters beyond ASCII.
MARKS = bytes(c for c in range(128) if not chr(c).isalpha() and c not in SPACE)
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

#: Rules in bit order: name and the SQL condition, over a ledger's measurements, that fails a text.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("shouting", "2 * n_upper > n_upper + n_lower"),
    ("no_letters", "100 * n_wordless > 40 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES: dict[str, int] = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": sum(BIT[k] for k in ("few_words", "repeated_words", "symbols", "repeated_lines", "shouting")),
    "v2": sum(BIT.values()),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_wordless")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words within a window of ``width`` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (ids[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    if any((ids[a + k] != ids[b + k]).any() for k in range(width)):  # two windows with one hash: count exactly
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            seen.setdefault(tuple(ids[i : i + width].tolist()), []).append(i)
        a = b = np.array([i for v in seen.values() if len(v) > 1 for i in v], np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.concatenate((a, b)))
    edge[starts] += 1
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, SPACE + CONTINUED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(text) - len(text.translate(None, UPPER)),
        len(text) - len(text.translate(None, LOWER)),
        len(words) - len(text.translate(None, MARKS).split()),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``failed_bits`` (bit i: rule i failed), one row per input row.

    Every rule is evaluated once, whatever the policies. A null or blank text has no words, so
    only ``few_words`` fails it. Very long texts are measured whole. No documents: no rows.
    """

    def make(batch: pa.RecordBatch) -> dict:
        rows = [measure(t) for t in batch["text"].to_pylist()]
        cols = np.array(rows, np.int64).reshape(-1, len(MEASURES))
        return {"doc_id": batch["doc_id"]} | {k: pa.array(cols[:, i]) for i, k in enumerate(MEASURES)}

    measured = arrow_map(documents(docs, id_col, text_col), make, "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES))
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed_bits", bits)


def stored(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a Parquet table (in the shared folder unless ``path`` is given): texts are measured once, and
    any policy or ablation, of this version or a later one, reads the stored bits and measurements.
    """
    rows = ledger(docs, id_col, text_col)
    path = path or shared_path(docs.sparkSession, "rule-ledger")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def fails(policy: int | str, bits: Column | None = None) -> Column:
    """Whether a ledger row fails a policy (a name of ``POLICIES`` or a mask)."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return (F.col("failed_bits") if bits is None else bits).bitwiseAND(F.lit(mask).cast("long")) != 0


def apply_policies(rows: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """The ledger with a boolean ``kept_<policy>`` for each policy."""
    return rows.withColumns({f"kept_{k}": ~fails(mask) for k, mask in policies.items()})


def ablations(rows: DataFrame, policy: int | str = "v1") -> DataFrame:
    """For each rule of a policy: documents it fails, those it alone fails, and how many would be kept without it.

    One pass over the ledger: it is first counted by ``failed_bits`` (256 values at most), and
    each rule's figures come from those counts by bitwise arithmetic.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    counts = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(b).cast("long").alias("bit")) for k, b in BIT.items() if b & mask])
    x = counts.select("bits", "n", F.inline(rules))
    one = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return x.groupBy("rule").agg(
        one(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        one(F.col("bits") == F.col("bit")).alias("n_only"),
        one(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
