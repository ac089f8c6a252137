"""Near-duplicates by the Jaccard similarity of word shingles: pigeonring chains of SimHashes and MinHash bands, then the exact similarity.

What chains and bands miss by chance is found by a prefix join of the sets that may link beyond their component: no pair at the similarity is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_map, cut, documents, drop_tables, noted
from .components import components

#: A pair at similarity s shares a band's key with probability s^ROWS, so it is met with 1 - (1 - s^ROWS)^BANDS: 0.9994 at 0.8.
BANDS, ROWS = 40, 8
#: So many members of a bucket are compared with all others; what they leave is found by its differences from them.
PIVOTS = 2
_random = np.random.default_rng(5)
_ODD = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_SALT = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def recall(similarity: float) -> float:
    """Probability that a pair of this similarity is met in a band."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one run, a blank one has none."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts)))


def set_key(hashes: np.ndarray) -> int:
    """64-bit hash of the whole set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).astype(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of its rows' least values, with the band's number."""
    import xxhash

    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 256):
            x = (hashes[at : at + 256, None] ^ _SALT) * _ODD
            x ^= x >> np.uint64(29)
            least = np.minimum(least, (x * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64)


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(x, p, n, m, d, tokens)`` of ``pairs(x, p)``: the sizes of both sets and the hashes that only one of them has."""
    a = sets.select(F.col("node").alias("x"), F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("p"), F.col("hashes").alias("b"))
    tokens = F.concat(F.array_except("a", "b"), F.array_except("b", "a"))
    return pairs.join(a, "x").join(b, "p").select("x", "p", F.size("a").alias("n"), F.size("b").alias("m"), tokens.alias("tokens")).withColumn("d", F.size("tokens"))


#: Jaccard similarity is 0.8 or more if the difference has at most a ninth of both sizes together.
LINKED = "9 * d <= n + m"
#: Bounds that decide how many places are listed are rounded up.
SLACK = 1e-6


def _across(compared: DataFrame) -> DataFrame:
    """``(x, y)``: candidates among the sets compared with a common pivot, of which one at least does not link to it.

    ``compared(x, p, n, m, d, tokens, nearest)``. The difference of x and y is that of their differences from
    the pivot p, so sets that link and are not both linked to p share at least
    o = (dx + dy - (nx + ny) / 9) / 2 > 0 tokens of these. Tokens are put in order, those rarest
    among the pivot's sets first; two such sets then share one at a place of dx - o + 1 or before in x and of dy - o + 1 or
    before in y. Only the set with the smaller difference, which p is the nearest of a bucket's pivots to,
    is looked up, and only by the places that some partner could need; edits that no other set
    has come first and are met by nobody. So copies edited in different ways make no pairs, however many there are.
    """
    bounds = compared.groupBy("p").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(~F.expr(LINKED)).alias("open"))
    rows = compared.join(bounds.where("open").drop("open"), "p").withColumn("linked", F.expr(LINKED))
    each = rows.select("p", "x", F.explode("tokens").alias("token"))
    counts = each.groupBy("p", "token").agg(F.count("*").alias("times"))
    ordered = each.join(counts, ["p", "token"]).groupBy("p", "x").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("order"))
    low, high = F.greatest(F.col("low"), 0.8 * F.col("n")), F.least(F.col("high"), 1.25 * F.col("n"))
    most = (F.col("n") + high) / 9
    rows = cut(rows.drop("tokens").join(ordered, ["p", "x"]).withColumn("most", most).withColumn("least", low), "pivot-differences")
    places = F.posexplode(F.slice("order", 1, F.greatest(F.lit(1), F.col("reach"))))
    # a linked set's partner is not linked to p, so its difference is over (n + m) / 9; another's partner has no smaller one
    overlap = F.when(F.col("linked"), (F.col("d") + (F.col("least") + F.col("m")) / 9 - F.col("most")) / 2).otherwise(F.col("d") - F.col("most") / 2)
    looked_up = rows.where("nearest and d > 0").withColumn("reach", F.floor(F.col("d") - overlap + 1 + SLACK).cast("int"))
    index = looked_up.where("reach > 0").select("p", F.col("x").alias("y"), F.col("n").alias("ny"), F.col("d").alias("dy"), F.col("linked").alias("ly"), places.alias("iy", "t")).select("p", "y", "ny", "dy", "ly", "iy", F.col("t.token").alias("token"))
    probing = rows.where("d > 0").withColumn("reach", F.floor(F.col("most") + 1 + SLACK).cast("int"))
    probe = probing.select("p", "x", "n", "d", "linked", places.alias("ix", "t")).select("p", "x", "n", "d", "linked", "ix", F.col("t.token").alias("token"))
    o = F.expr("(9 * (d + dy) - n - ny + 17) div 18")
    near = (F.col("d") >= F.col("dy")) & (F.col("x") != F.col("y")) & ~(F.col("linked") & F.col("ly")) & _close("n", "ny") & (F.col("ix") <= F.col("d") - o) & (F.col("iy") <= F.col("dy") - o)
    return probe.join(index, ["p", "token"]).where(near).select("x", "y")


def _close(n: str, m: str):
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def links(nodes: DataFrame, rows: DataFrame, shingle: int = 5) -> DataFrame:
    """``(node, root)`` of the nodes that link: components of the pairs with similarity 0.8 or more.

    ``nodes(node, n, keys, fp, text_key)`` are distinct sets, ``rows(text_key, text)`` hold a text of each. Pairs meet
    by the pigeonring chains of their fingerprints or in a band's bucket, and are verified exactly. In a
    bucket every set is compared with pivots, those with most company first, then one among the sets
    that none of the pivots links to; the pairs that remain are those of ``_across``. So a bucket's work grows
    with its members, and no pair in it that links is lost. Pairs that meet nowhere are left to ``near_duplicates``.
    """
    banded = nodes.select("node", "n", F.explode("keys").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    met = cut(banded.join(sizes, "key"), "band-buckets")
    company = met.groupBy("node").agg(F.sum("times").alias("company"))
    met = cut(met.join(company, "node"), "band-company")
    alike = cut(simhash_pairs(nodes), "simhash-pairs")

    def make(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, shingle).view(np.int64) for t in batch["text"].to_pylist()]
        return {"node": batch["node"], "hashes": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))}

    used = met.select("node").unionByName(alike.select(F.explode(F.array("x", "p")).alias("node"))).distinct()
    wanted = nodes.join(used, "node", "left_semi").select("node", "text_key")
    sets = cut(arrow_map(rows.join(wanted, "text_key").select("node", "text").dropDuplicates(["node"]), make, "node long, hashes array<long>"), "shingle-sets")

    found = _differences(alike, sets).where(LINKED).select("x", "p")
    open_, compared, pivots = met.select("key", "node", "company"), None, None
    for _ in range(PIVOTS):
        chosen = open_.groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("p"), F.count("*").alias("m")).where("m > 1").select("key", "p")
        chosen = cut(chosen, "pivots")
        pivots = chosen if pivots is None else pivots.unionByName(chosen)
        pairs = met.select("key", F.col("node").alias("x")).join(chosen, "key").where("x <> p").select("x", "p").distinct()
        if compared is not None:
            pairs = pairs.join(compared.select("x", "p"), ["x", "p"], "left_anti")
        new = cut(_differences(pairs, sets), "compared")
        compared = new if compared is None else compared.unionByName(new)
        # open: buckets' sets that are no pivot and link to none of the bucket's pivots
        covered = pivots.join(compared.where(LINKED).select(F.col("x").alias("node"), "p"), "p").select("key", "node").unionByName(pivots.select("key", F.col("p").alias("node"))).distinct()
        left = open_.join(chosen.select("key"), "key", "left_semi").join(covered, ["key", "node"], "left_anti")
        open_ = cut(left, "open-buckets")
    each = met.select("key", F.col("node").alias("x")).join(pivots, "key").join(compared.select("x", "p", "d"), ["x", "p"])
    nearest = each.groupBy("key", "x").agg(F.min_by("p", F.struct("d", "p")).alias("p")).select("x", "p").distinct().withColumn("nearest", F.lit(True))
    ready = cut(compared.join(nearest, ["x", "p"], "left").withColumn("nearest", F.coalesce("nearest", F.lit(False))), "compared-nearest")
    candidates = cut(_across(ready).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("p")).distinct(), "pairs")
    found = found.unionByName(compared.where(LINKED).select("x", "p")).unionByName(_differences(candidates, sets).where(LINKED).select("x", "p"))
    return components(cut(found.select(F.col("x").alias("u"), F.col("p").alias("v")), "links"))


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """``(x, p)``: pairs that the pigeonring operator links, by one set of each fingerprint; sets of one fingerprint with that one."""
    one = nodes.groupBy("fp").agg(F.min("node").alias("p"), F.count("*").alias("m"))
    edges = simhash.links(one.select("fp"))
    same = nodes.join(one.where("m > 1"), "fp").where("node <> p").select(F.col("node").alias("x"), "p")
    u, v = one.select(F.col("fp").alias("u"), F.col("p").alias("x")), one.select(F.col("fp").alias("v"), "p")
    return same.unionByName(edges.join(u, "u").join(v, "v").select("x", "p")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row per input row: ``doc_id, text_key, component``; components of all pairs of texts with similarity 0.8 or more.

    Sets of shingles are compared: A-Z is lower-cased, fewer words than a shingle are one shingle, and
    texts without words are copies of each other. Equal sets are one node, so copies never make pairs.
    ``text_key`` is ``xxhash64`` of the text as a string. No documents give no rows.
    """
    from .metric_join import links_across  # which is made of this module's parts

    rows = documents(docs, id_col, text_col).withColumn("text_key", F.xxhash64(F.col("text").cast("string")))

    def make(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, shingle) for t in batch["text"].to_pylist()]
        return {
            "doc_id": batch["doc_id"],
            "text_key": batch["text_key"],
            "node": pa.array([set_key(s) for s in sets], pa.int64()),
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "keys": pa.array([bands(s).tolist() for s in sets], pa.list_(pa.int64())),
            "fp": pa.array([simhash.majority(s) for s in sets], pa.int64()),
        }

    made = cut(arrow_map(rows, make, "doc_id long, text_key long, node long, n long, keys array<long>, fp long"), "minhashes")
    nodes = cut(made.groupBy("node").agg(F.min("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.min("text_key").alias("text_key")), "shingle-nodes")
    with noted() as used:
        roots = cut(links(nodes, rows.select("text_key", "text"), shingle), "roots")
    drop_tables(docs.sparkSession, used[:-1])
    out = made.select("doc_id", "text_key", "node").join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("component"))
    more = links_across(rows, nodes.select("node", "text_key"), roots, shingle)
    if more is None:
        return out
    root = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    more = more.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    merged = components(more).select(F.col("node").alias("component"), F.col("root").alias("whole"))
    return out.join(merged, "component", "left").select("doc_id", "text_key", F.coalesce("whole", "component").alias("component"))
