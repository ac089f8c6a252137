"""Exact join of word-shingle sets by Jaccard distance: regions around pivots, windows by the triangle inequality, joined again and again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, documents
from .components import components
from .jaccard import LINKED, _across, _differences, set_key, shingles

#: Sets link at a Jaccard distance of this or less.
NEAR = 0.2
#: Added to every window, so that rounding loses no pair.
SLACK = 1e-9
#: Pivots of a region, sets of a region whose pairs are compared at once, and times that regions are split.
PIVOTS, LEAF, ROUNDS = 2, 64, 2
#: Documents (about) and shingles of the sample that tells which shingles are common. It sets an order of shingles and so the time taken, never the result.
SAMPLE, COMMON = 20_000, 1 << 18
#: Of a set of n: shingles of the prefix that are left out (no more than a set 4/5 as large has beyond what it needs), and those beyond the prefix.
LEFT_OUT, BEYOND = "(cast(ceil(4 * {n} / 5) as bigint) div 10)", "(cast(ceil(4 * {n} / 5) as bigint) - 1 - {n} div 10)"


def common_shingles(rows: DataFrame, size: int) -> np.ndarray:
    """The shingles that most texts of a sample have, the rarest first: ``COMMON`` at most."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0).select("text").distinct()

    def make(batch: pa.RecordBatch) -> dict:
        return {"token": pa.array(np.concatenate([np.zeros(0, np.uint64), *[shingles(t, size) for t in batch["text"].to_pylist()]]).view(np.int64))}

    often = arrow_map(some, make, "token long").groupBy("token").agg(F.count("*").alias("times")).where("times > 3").orderBy(F.desc("times"), "token").limit(COMMON)
    found = often.toArrow()
    token = found["token"].to_numpy()
    return token[np.lexsort((-token, found["times"].to_numpy()))].view(np.uint64)


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, common ones last: two sets within ``NEAR`` share at least 1 + n / 10 of these, n the smaller size.

    The intersection has 4/5 of the larger set at least, so 4 n / 5 of n shingles, and one of the n - 4 n / 5 + 1 first is among them; n / 10 more
    are for ``first_regions`` to leave out.
    """
    at = np.searchsorted(common, hashes)
    at[at == len(common)] = 0
    known = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
    order = np.concatenate((hashes[~known], hashes[known][np.argsort(rank[at[known]], kind="stable")]))
    return order[: len(hashes) - (4 * len(hashes) + 4) // 5 + 1 + len(hashes) // 10]


def shingle_sets(rows: DataFrame, size: int, often: np.ndarray | None = None) -> DataFrame:
    """``doc_id, text_key, node, n, prefix`` of ``rows(doc_id, text_key, text)``; ``node`` names the set, null for a text without words. ``often``: common shingles, if known."""
    often = common_shingles(rows, size) if often is None else often
    order = np.argsort(often)
    sent = rows.sparkSession.sparkContext.broadcast((often[order], order))

    def make(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, size) for t in batch["text"].to_pylist()]
        return {
            "doc_id": batch["doc_id"],
            "text_key": batch["text_key"],
            "node": pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "prefix": pa.array([prefix(s, *sent.value).view(np.int64) for s in sets], pa.list_(pa.int64())),
        }

    return arrow_map(rows, make, "doc_id long, text_key long, node long, n long, prefix array<long>")


def _different(regions: DataFrame) -> DataFrame:
    """``region, node, n, own, m, weight``: regions with two sets or more, at least one its ``own``; one of those with the same sets.

    Same sets are told by their number and 128 bits of hashes; ``weight`` regions are told to be the same, ``m`` sets are in each.
    """
    sums = regions.groupBy("region").agg(F.count("*").alias("m"), F.bool_or("own").alias("some"), F.bit_xor(F.xxhash64("node", "own")).alias("a"), F.bit_xor(F.xxhash64("node", "own", F.lit(1))).alias("b")).where("m > 1 and some")
    return regions.join(sums.groupBy("m", "a", "b").agg(F.min("region").alias("region"), F.count("*").alias("weight")).drop("a", "b"), "region")


def first_regions(nodes: DataFrame) -> DataFrame:
    """Regions of sets of like size that share a shingle of their prefixes, as ``_different`` gives them.

    Most texts have no shingle in common: their distance is 1, from each other and from any pivot, so pivots alone
    can't part them. Sets within ``NEAR`` always meet in one of these regions. Sizes differ by a quarter at most
    then, so a region has the sizes of one class, its own, and of the next.

    The sample doesn't tell how common the rarer shingles are, and the larger the table, the more of them have many sets. So each set leaves out
    the ``LEFT_OUT`` shingles of its prefix that are in most prefixes. Sets within ``NEAR`` share more than either leaves out, and of these the one
    in fewest prefixes has as many behind it: both keep it.
    """
    each = nodes.select("node", F.explode("prefix").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    met = cut(each.join(shared, "token"), "shared-shingles").join(nodes.select("node", "n"), "node")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("times"), F.desc("token")))
    met = met.withColumn("place", place).where(F.col("place") > F.expr(LEFT_OUT.format(n="n")))
    level = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("long")
    placed = met.select("node", "n", "token", F.inline(F.array(F.struct(level.alias("level"), F.lit(True).alias("own")), F.struct((level - 1).alias("level"), F.lit(False).alias("own")))))
    return _different(placed.select(F.xxhash64("token", "level").alias("region"), "node", "n", "own"))


def close_pairs(regions: DataFrame) -> DataFrame:
    """``x, p, c``: pairs of sets of small regions whose sizes fit, and in how many of them (told apart by their shingle) they meet."""
    few = regions.where(F.col("m") <= LEAF)
    a = few.select("region", "weight", F.col("node").alias("x"), "n", "own")
    b = few.select("region", F.col("node").alias("p"), F.col("n").alias("np"), F.col("own").alias("own_p"))
    close = 5 * F.least("n", "np") >= 4 * F.greatest("n", "np")
    return a.join(b, "region").where("x < p and (own or own_p)").where(close).groupBy("x", "p").agg(F.sum("weight").alias("c"), F.first("n").alias("n"), F.first("np").alias("np"))


#: Sets within NEAR have 4/9 of both sizes in common. Beyond the end of the prefix that ends first, at most the rest of that set is; the others are in both
#: prefixes. What a set leaves out of them are those in most prefixes, so both together leave out no more than one of them does.
ENOUGH = f"c >= ceil(4 * (n + np) / 9) - greatest({BEYOND.format(n='n')}, {BEYOND.format(n='np')}) - greatest({LEFT_OUT.format(n='n')}, {LEFT_OUT.format(n='np')})"


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``x, p, d``: the Jaccard distance of the pairs."""
    a = sets.select(F.col("node").alias("x"), F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("p"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "x").join(b, "p").select("x", "p", both.alias("i"), (F.size("a") + F.size("b") - both).alias("u")).select("x", "p", F.expr("(u - i) / u").alias("d"), F.expr("5 * i >= 4 * u").alias("near"))


def around_pivots(regions: DataFrame, sets: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Distances of all sets of a region to its pivots, ``region, node, j, p, d``; and all distances known so far, ``x, p, d, near``.

    The first pivot is the set in most regions, so regions of the same texts have the same; each next one is the set
    farthest from those before, as long as one is farther than ``NEAR`` from all.
    """
    company = regions.groupBy("node").agg(F.count("*").alias("company"))
    left = regions.join(company, "node").select("region", "node", F.struct(F.lit(2e0).alias("d"), "company", "node").alias("rank"), F.lit(2e0).alias("nearest"))
    out = None
    for j in range(PIVOTS):
        chosen = left.where(F.col("nearest") > NEAR).groupBy("region").agg(F.max_by("node", "rank").alias("p"))
        asked = left.join(chosen, "region")
        pairs = asked.where("node <> p").select(F.col("node").alias("x"), "p").distinct()
        new = pairs if known is None else pairs.join(known.select("x", "p"), ["x", "p"], "left_anti")
        new = cut(distances(new, sets), "distances")
        known = new if known is None else known.unionByName(new)
        at = asked.join(known.select(F.col("x").alias("node"), "p", "d"), ["node", "p"], "left").withColumn("d", F.coalesce("d", F.lit(0e0)))
        at = cut(at.select("region", "node", "rank", "nearest", "p", "d"), "compared")
        rows = at.select("region", "node", F.lit(j).alias("j"), "p", "d")
        out = rows if out is None else out.unionByName(rows)
        if j + 1 < PIVOTS:
            nearest = F.least("nearest", "d")
            left = at.select("region", "node", F.struct(nearest.alias("d"), F.col("rank.company").alias("company"), "node").alias("rank"), nearest.alias("nearest"))
    return out, known


def split(at: DataFrame, n: DataFrame) -> DataFrame:
    """The regions of ``at(region, node, j, p, d)``'s pivots that may hold links not found yet.

    A set belongs to its nearest pivot. For x of pivot p and y of a later pivot q within ``NEAR`` of x,
    d(y, p) <= d(x, p) + NEAR <= d(y, q) + 2 NEAR, and d(x, p) is at most p's radius: y comes into p's region by that window.
    Sets linked with p are in one component already: a region all of whose sets are is done, and of another one those nearer to
    p than its nearest unlinked set less ``NEAR`` have no more to find. Pivots have been compared with all.
    """
    home = at.groupBy("region", "node").agg(F.min_by(F.struct("j", "d"), F.struct("d", "j")).alias("home"))
    rows = at.join(home, ["region", "node"]).select("region", "node", "p", "d", F.col("home.d").alias("nearest"), (F.col("home.j") - F.col("j")).alias("later")).where("later >= 0 and d > 0")
    about = rows.groupBy("region", "p").agg(F.max(F.when(F.col("later") == 0, F.col("d"))).alias("radius"))
    window = F.least(F.col("nearest") + 2 * NEAR, F.col("radius") + NEAR) + SLACK
    rows = rows.join(about, ["region", "p"]).where((F.col("later") == 0) | (F.col("d") <= window))
    bars = rows.where(F.col("d") > NEAR).groupBy("region", "p").agg(F.min("d").alias("bar"))
    rows = rows.join(bars, ["region", "p"]).where(F.col("d") >= F.col("bar") - NEAR - SLACK)
    return _different(rows.select(F.xxhash64("region", "p").alias("region"), "node", (F.col("later") == 0).alias("own")).join(n, "node"))


def links(nodes: DataFrame, rows: DataFrame, size: int = 5) -> DataFrame:
    """``u, v``: links whose components are those of all pairs of sets within ``NEAR``.

    ``nodes(node, n, prefix, text_key)`` are distinct sets, ``rows(text_key, text)`` hold a text of each. Regions of up to ``LEAF`` sets
    are compared pair by pair, if they share enough shingles of their prefixes (a pair that shares some in a larger region meets there as well);
    larger ones are split around pivots, ``ROUNDS`` times. What is left then are sets that no pivot parts, such as
    copies edited in different ways: they are joined by their differences from a pivot (``jaccard._across``), exactly as well.
    """
    regions = cut(first_regions(nodes), "regions")
    leaves = cut(close_pairs(regions).where(ENOUGH).select("x", "p"), "leaf-pairs")
    large = cut(regions.where(F.col("m") > LEAF).select("region", "node", "n"), "large-regions")
    used = leaves.select(F.explode(F.array("x", "p")).alias("node")).unionByName(large.select("node")).distinct()
    wanted = nodes.join(used, "node", "left_semi").select("node", "text_key")

    def make(batch: pa.RecordBatch) -> dict:
        return {"node": batch["node"], "hashes": pa.array([shingles(t, size).view(np.int64) for t in batch["text"].to_pylist()], pa.list_(pa.int64()))}

    sets = cut(arrow_map(rows.join(wanted, "text_key").select("node", "text").dropDuplicates(["node"]), make, "node long, hashes array<long>"), "shingle-sets")
    sizes = large.select("node", "n").distinct()
    some = cut(sets.join(sizes, "node", "left_semi"), "large-sets")
    known, pairs = None, None
    for _ in range(ROUNDS):
        at, known = around_pivots(large.select("region", "node"), some, known)
        regions = cut(split(at, sizes), "regions")
        new = cut(close_pairs(regions).select("x", "p"), "leaf-pairs")
        pairs = new if pairs is None else pairs.unionByName(new)
        large = regions.where(F.col("m") > LEAF).select("region", "node", "n")
    company = large.groupBy("node").agg(F.count("*").alias("company"))
    chosen = large.join(company, "node").groupBy("region").agg(F.max_by("node", F.struct("company", "node")).alias("p"))
    last = cut(_differences(large.join(chosen, "region").where("node <> p").select(F.col("node").alias("x"), "p").distinct(), some), "differences")
    across = _across(last.withColumn("nearest", F.lit(True))).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("p"))
    left = cut(pairs.unionByName(across).distinct().join(known.select("x", "p"), ["x", "p"], "left_anti"), "left-pairs")
    checked = distances(leaves, sets).unionByName(distances(left, some)).where("near")
    found = checked.select("x", "p").unionByName(known.where("near").select("x", "p")).unionByName(last.where(LINKED).select("x", "p"))
    return found.select(F.col("x").alias("u"), F.col("p").alias("v"))


def open_sets(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``node``: of ``sets(node, n, prefix)`` those that may link with one of another component of ``roots(node, root)``; a set not in it is one by itself.

    Sets within ``NEAR`` share over ``LEFT_OUT`` shingles of their prefixes (see ``prefix``). If they are of two components, so is each of these
    shingles; sets with no more such shingles are done. Copies share theirs within one component, others share few.
    """

    def several(rows: DataFrame, what: str) -> DataFrame:
        here = Window.partitionBy("token")
        rows = rows.select("*", F.min(what).over(here).alias("low"), F.max(what).over(here).alias("high"))
        return rows.where("low < high").drop("low", "high")

    each = sets.where("n > 0").select("node", "n", F.explode("prefix").alias("token"))
    met = cut(several(each, "node"), "shared-prefixes")
    met = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shared = several(met, "root").select("node", "n", "token").distinct().groupBy("node", "n").agg(F.count("*").alias("c"))
    return shared.where(F.col("c") > F.expr(LEFT_OUT.format(n="n"))).select("node")


def links_across(rows: DataFrame, nodes: DataFrame, roots: DataFrame, size: int = 5) -> DataFrame | None:
    """``u, v``: links that make one component of all that ``roots(node, root)`` keep apart though sets of theirs are within ``NEAR``; null if no set may have one.

    ``rows(doc_id, text_key, text)`` are all texts, ``nodes(node, text_key)`` name one of each set. Only ``open_sets`` are joined, exactly.
    """
    often = common_shingles(rows, size)
    left = cut(open_sets(shingle_sets(rows, size, often), roots).join(nodes, "node").select("text_key").distinct(), "open-sets")
    if left.isEmpty():
        return None
    some = rows.join(left, "text_key", "left_semi")
    made = shingle_sets(some, size, often).groupBy("node").agg(F.min("n").alias("n"), F.first("prefix").alias("prefix"), F.min("text_key").alias("text_key"))
    return links(cut(made, "open-prefixes"), some.select("text_key", "text"), size)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``, the least id that links reach.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, a text's set is that of its runs of ``size`` words, or of all its words if there are
    fewer. Null and blank texts have no set and link with nothing. Texts are read whole; equal sets are one node, so copies make no pairs. A
    null id keeps its row and is a component's id only where it holds no other. Repeated rows give a row each, no documents none.
    """
    rows = documents(docs, id_col, text_col).withColumn("text_key", F.xxhash64(F.col("text").cast("string")))
    made = cut(shingle_sets(rows, size), "shingle-prefixes")
    nodes = made.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.first("prefix").alias("prefix"), F.min("text_key").alias("text_key"))
    roots = components(links(nodes, rows.select("text_key", "text"), size))
    named = made.select("doc_id", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return named.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
