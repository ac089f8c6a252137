"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .ranking import SLOTS, each_copy, ranked, ring_key

#: A place is ranked in so many parts.
PARTS = 256


def ring(shards: int, nodes: int = 64) -> list[int]:
    """For each place the shard whose virtual node comes next, going clockwise; of nodes at one place the least shard's counts."""
    at = sorted((int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:3], 16), s) for s in range(shards) for v in range(nodes))
    owner, j = [], 0
    for place in range(SLOTS):
        while j < len(at) and at[j][0] < place:
            j += 1
        owner.append(at[j % len(at)][1])
    return owner


def allot(counts: Mapping[int, int], shards: int, nodes: int = 64) -> list[tuple[int, int, int, int]]:
    """``(place, first, shard, slot)``: from rank ``first`` of a place, its keys go to ``shard`` from ``slot`` on.

    Every shard takes the floor or ceiling of the mean, so all keys fit and all shards are full
    in the end. First each place fills its own shard, in ring order; what finds it full goes on
    clockwise to the next virtual node of a shard with room.
    """
    total, owner = sum(counts.values()), ring(shards, nodes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, out, over = [0] * shards, [], []

    def give(place: int, first: int, n: int, s: int) -> int:
        take = min(n, room[s] - filled[s])
        if take:
            out.append((place, first, s, filled[s]))
            filled[s] += take
        return take

    for place in sorted(counts):
        took = give(place, 0, counts[place], owner[place])
        if took < counts[place]:
            over.append((place, took, counts[place] - took))
    for place, first, n in over:
        step = 1
        while n:
            s = owner[(place + step) % SLOTS]
            took = give(place, first, n, s)
            first, n, step = first + took, n - took, step + 1
    return out


def shard(docs: DataFrame, shards: int = 16, nodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``rows``: shards' counts differ by one at most. Keys (ids) lie on a ring of ``SLOTS``
    places by MD5, each shard has ``nodes`` virtual nodes, and what overflows a full shard goes
    on clockwise. Only the number of keys at each place (``SLOTS`` numbers) comes to the driver;
    rows are ranked by place and pick their shard by rank. Slots are gapless from 0 in every
    shard. Null ids share a place, which is ranked in ``PARTS`` parts by a hash of the whole row; equal
    rows count each, and are ranked as one row with a number. Null texts have size 1 and the crc32
    of the empty text. ``grown_shard`` is null: with bounded loads one more shard moves a few
    other keys too. No documents: no rows.
    """
    digest, place = ring_key("doc_id")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # written once, so that texts are read once
    different = cut(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), "shard-rows")
    mixed = F.xxhash64("doc_id", "size", "text_crc32")
    keyed = different.select("*", place.alias("ring"), F.pmod(mixed, F.lit(PARTS)).cast("int").alias("part"), digest.alias("digest"))
    counts = {r["ring"]: r["n"] for r in different.select(place.alias("ring"), "copies").groupBy("ring").agg(F.sum("copies").alias("n")).collect()}
    parts: dict[int, list[str]] = {}
    for p, first, s, slot in allot(counts, shards, nodes):
        parts.setdefault(p, []).append(f"{first},{s},{slot}")
    plan = "|".join(f"{p}:{';'.join(v)}" for p, v in parts.items())
    one = F.split(F.col("x"), ":")
    moves = F.transform(F.split(one[1], ";"), lambda m: F.struct(F.split(m, ",")[0].cast("long").alias("first"), F.split(m, ",")[1].cast("int").alias("shard"), F.split(m, ",")[2].cast("long").alias("slot")))
    table = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(plan), r"\|")).alias("x")).where("x <> ''").select(one[0].cast("int").alias("ring"), moves.alias("moves"))
    placed = each_copy(ranked(keyed, ["ring"], "part", ["digest", "doc_id", "text_crc32", "size"]))
    # SLOTS rows at most
    placed = placed.join(F.broadcast(table), "ring").withColumn("move", F.element_at(F.filter("moves", lambda m: m["first"] <= F.col("rank")), -1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("move.shard").alias("shard"),
        (F.col("move.slot") + F.col("rank") - F.col("move.first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
