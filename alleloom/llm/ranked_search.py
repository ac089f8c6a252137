"""Ranked lexical search: an inverted index in shards, and MaxScore over each shard's postings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, pieces
from .decontamination import blocks

#: ASCII letters in small form, digits and bytes beyond ASCII stay; all others part terms.
TERMS = bytes(c + 32 if chr(c).isupper() else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: A shard ends with the document that brings its texts to so many bytes, or their number to so many.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 15
#: A shard's documents are scored in runs of so many, and the bar that they must reach rises after each.
RUN = 1024
INDEX = "shard long, term binary, n long, tokens long, places binary, counts binary"


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERMS).split()


def _cells(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary cells, each of the next ``counts`` values."""
    ends = np.concatenate(([0], np.cumsum(counts))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


class Shard:
    """Documents of one shard; those without terms are counted nowhere."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.owned: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found, known = terms(text), self.vocabulary
        if found:
            self.ids.append(doc_id)
            self.owned.append(np.fromiter((known.setdefault(t, len(known)) for t in found), np.int32, len(found)))
            self.size += len(text)

    def full(self) -> bool:
        return self.size >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def rows(self) -> pa.RecordBatch:
        """A row for each term with its postings, and one without a term for the documents: ids, and lengths that are negative where the id is null."""
        lengths = np.array([len(x) for x in self.owned], np.int64)
        n = len(lengths)
        keys = np.concatenate(self.owned).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        keys, times = np.unique(keys, return_counts=True)
        term, place = keys // n, keys % n
        df = np.bincount(term, minlength=len(self.vocabulary))
        tokens = np.bincount(term, weights=times, minlength=len(self.vocabulary)).astype(np.int64)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        signed = np.where([i is None for i in self.ids], -lengths, lengths)
        own = [pa.array([None], pa.binary()), pa.array([n]), pa.array([int(lengths.sum())]), _cells(ids, np.array([n])), _cells(signed, np.array([n]))]
        post = [pa.array(list(self.vocabulary), pa.binary()), pa.array(df), pa.array(tokens), _cells(place.astype(np.int32), df), _cells(times.astype(np.int32), df)]
        cols = [pa.concat_arrays(pair) for pair in zip(own, post, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), self.number)), *cols], names=["shard", "term", "n", "tokens", "places", "counts"])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of whole texts, as rows of ``INDEX``; made in one pass, without a shuffle.

    A shard is a run of documents of one task. A term's ``places`` are its documents' numbers in the shard and
    ``counts`` its occurrences there, as 32-bit integers; ``n`` is how many documents hold it. The row without a
    term has the ids and lengths of the shard's documents as 64-bit integers. Write it once (``cut``) and search it often: statistics
    of the whole collection are sums over shards, so shards of later documents can be added to it.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held = Shard(first)
        for batch in batches:
            for piece in pieces(batch):
                for doc_id, text in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist(), strict=True):
                    held.add(doc_id, text)
                    if held.full():
                        yield held.rows()
                        held = Shard(held.number + 1)
        if held.ids:
            yield held.rows()

    return documents(docs, id_col, text_col).mapInArrow(make, INDEX)


def weight(n: int, df: int) -> int:
    """Of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df + 1)))


class Postings:
    """The postings of one shard that a block of items asks for, with each term's bound: its largest share of any score, before the weight."""

    def __init__(self, table: pa.Table, n_documents: int, n_tokens: int):
        rows = table.to_pydict()
        own = rows["term"].index(None)
        lengths = np.frombuffer(rows["counts"][own], np.int64)
        self.none, self.ids = lengths < 0, np.frombuffer(rows["places"][own], np.int64)
        m = 50 + 50 * np.abs(lengths) * n_documents // n_tokens
        asked = [i for i in range(len(rows["term"])) if i != own]
        self.number = {rows["term"][i]: k for k, i in enumerate(asked)}
        self.place = np.frombuffer(b"".join(rows["places"][i] for i in asked), np.int32).astype(np.int64)
        times = np.frombuffer(b"".join(rows["counts"][i] for i in asked), np.int32).astype(np.int64)
        self.share = 1_000_000_000 * times // (1000 * times + 20 * m[self.place])
        df = np.array([rows["n"][i] for i in asked], np.int64)
        ends = np.cumsum(df)
        self.bound = np.maximum.reduceat(self.share, ends - df) if len(df) else df
        self.runs = -(-len(self.ids) // RUN)
        cell = np.repeat(np.arange(len(df)) * self.runs, df) + self.place // RUN
        self.start = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=len(df) * self.runs)))).tolist()

    def best(self, wanted: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents: higher scores first, then smaller ids, null ids last.

        MaxScore: lists are in order of their bounds. Those whose bounds together stay under the bar are
        non-essential: no document that only they hold can reach it. The others are added up, and a non-essential list is looked
        up only for documents that may still reach the bar with all that are left. The bar is the k-th best score so far.
        """
        lists = sorted(((w * int(self.bound[t]), t, w) for t, w in ((self.number[x], w) for x, w in wanted if x in self.number)), key=lambda x: x[0])
        lists = [x for x in lists if x[0] > 0]
        reach = np.cumsum([x[0] for x in lists]).tolist()
        places, scores, bar = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        for run in range(self.runs if lists else 0):
            first = next((i for i, r in enumerate(reach) if r >= bar), len(lists))
            if first == len(lists):
                break
            total = np.zeros(RUN, np.int64)
            for _, t, w in lists[first:]:
                a, b = self.start[t * self.runs + run], self.start[t * self.runs + run + 1]
                if a < b:
                    total[self.place[a:b] - run * RUN] += w * self.share[a:b]
            met = np.flatnonzero(total)
            for i in range(first - 1, -1, -1):
                met = met[total[met] + reach[i] >= bar]
                if not len(met):
                    break
                _, t, w = lists[i]
                a, b = self.start[t * self.runs + run], self.start[t * self.runs + run + 1]
                if a < b:
                    held = self.place[a:b] - run * RUN
                    at = np.searchsorted(held, met)
                    at[at == len(held)] = 0
                    has = held[at] == met
                    total[met[has]] += w * self.share[a:b][at[has]]
            met = met[total[met] >= bar]
            if len(met):
                places, scores = np.concatenate((places, met + run * RUN)), np.concatenate((scores, total[met]))
                order = np.lexsort((self.ids[places], self.none[places], -scores))[:k]
                places, scores = places[order], scores[order]
                bar = max(1, int(scores[-1])) if len(scores) == k else 1
        return places, scores


def _leaders(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ranker(sent, n_documents: int, n_tokens: int, k: int):
    """A function from a shard's postings to the leaders of each item among its documents."""

    def rank(shard: pa.Table) -> pa.Table:
        own, item, place, score = Postings(shard, n_documents, n_tokens), [], [], []
        for i, wanted in sent.value:
            places, scores = own.best(wanted, k)
            item.append(np.full(len(places), i, np.int64))
            place.append(places)
            score.append(scores)
        item, place, score = (np.concatenate(x) for x in (item, place, score))
        number = np.full(len(item), shard["shard"][0].as_py(), np.int64)
        return pa.table({"shard": number, "item_id": item, "doc_id": pa.array(own.ids[place], mask=own.none[place]), "score": score})

    return rank


def search(shards: DataFrame, queries: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 50, block_bytes: int = 4 << 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item over all shards.

    The queries are the stated set that all documents are ranked for: they go through in blocks of ``block_bytes``, whose terms and weights are
    broadcast. Items and documents without terms (null, empty) have no rows, nor have scores of 0. An item id with several texts
    asks for all their terms, each once; items without an id are not searched for. Repeated documents are ranked each, equal scores by id, null ids last.
    """
    spark, out = shards.sparkSession, None
    sums = shards.where("term is null").agg(F.sum("n"), F.sum("tokens")).first()
    n_documents, n_tokens = sums[0] or 0, sums[1] or 0
    # an item is one row, so that it is in one block
    items = queries.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).dropna().groupBy("item_id").agg(F.concat_ws(" ", F.collect_set("text")).alias("text"))
    following = blocks(items, "item_id", "text", block_bytes) if n_documents else iter(())
    block = next(following, None)
    while block is not None:
        asked: dict[int, set[bytes]] = {}
        for item, text in block:
            asked.setdefault(item, set()).update(terms(text))
        # the terms of one block
        found = shards.join(F.broadcast(spark.createDataFrame([(bytearray(t),) for t in sorted(set().union(*asked.values()))], "term binary")), "term", "left_semi")
        weights = {bytes(r["term"]): weight(n_documents, r["df"]) for r in found.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        sent = spark.sparkContext.broadcast([(i, [(t, weights[t]) for t in sorted(ts) if t in weights]) for i, ts in sorted(asked.items())])
        part = found.unionByName(shards.where("term is null")).groupBy("shard").applyInArrow(_ranker(sent, n_documents, n_tokens, k), "shard long, item_id long, doc_id long, score long")
        block = next(following, None)
        if out is not None or block is not None:
            part = cut(part, "ranked-block")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return shards.where("false").select(F.col("shard").alias("item_id"), F.lit(0).alias("rank"), F.col("shard").alias("doc_id"), F.col("n").alias("score"))
    # an item's leaders of many shards meet in parts first, then those of the parts
    few = _leaders(out.withColumn("part", F.pmod("shard", F.lit(64))), ["item_id", "part"], k)
    return _leaders(few.drop("rank", "part"), ["item_id"], k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
