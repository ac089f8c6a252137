"""Correlation of variants: all pairs of a region, or one variant against a region.

Calls are first gathered into sparse columns, a row for a variant and up to ``ROW`` haplotypes (or samples): who carries it, who misses.
Everything else reads that one aggregate, so its exchange is reused. A pair's sums come from an
equi-join on the haplotype (or sample), so only shared carriers are ever paired; pairs that
share nobody come from the variants alone. For regions where many samples carry most variants,
``dense_pairs`` multiplies blocks instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.variants import identifier, segment
from .genotype import in_region, unit
from .whole_groups import ENTRIES, MEMBERS, whole_pairs

METRICS = ("r", "rsquare", "rsquare_approx", "cov", "dprime")
VARIANT = ("chrom", "pos", "variant")
#: Variants are spread over so many blocks where pairs are formed from variants alone.
BLOCKS = 16
#: Haplotypes or samples (about) whose entries of one variant are a row; larger cohorts have several rows a variant.
ROW = 1 << 16
#: From this mean share of carriers on, multiplying blocks takes less than joining carriers.
DENSE = 0.05


def columns(calls: DataFrame, n: int, metric: str) -> DataFrame:
    """Variants that someone carries: ``chrom, pos, variant, s, fill, g``, a row for each ``ROW`` of the ``n`` haplotypes or samples.

    ``calls``: haplotypes (``sample, hap``) for r, r squared and D', samples with counts for covariances.
    A carried or missing haplotype counts 1; a sample's missing count is the mean over all ``n``. ``s``
    is the sum of these values, ``fill`` what stands for a missing one (both of the whole variant), ``g`` the entries.
    """
    if metric not in METRICS:
        raise QueryError(f"unknown metric {metric}")
    key = unit(calls)
    total = {"ac": F.sum(F.col("dosage").cast("double")), "missing": F.count_if(F.col("dosage").isNull()), "entries": F.count("*")}
    if n > ROW:
        # only variants of so many calls have several rows; a window, so that calls are shuffled once
        here = Window.partitionBy(*VARIANT)
        calls = calls.select(*VARIANT, *key, "dosage", *[c.over(here).alias(k) for k, c in total.items()])
        piece = F.pmod(F.xxhash64(*key), F.ceil(F.col("entries") / F.lit(ROW)))
        found = calls.groupBy(*VARIANT, *total, piece.alias("piece")).agg(F.collect_list(F.struct(*key, "dosage")).alias("g"))
    else:
        found = calls.groupBy(*VARIANT).agg(*[c.alias(k) for k, c in total.items()], F.collect_list(F.struct(*key, "dosage")).alias("g"))
    # the size and the count keep the entries and missing calls in the aggregate of every reader, so that all read the same exchange
    found = found.where((F.col("ac") > 0) & (F.size("g") > 0) & (F.col("missing") >= 0))
    fill = F.col("ac") / F.lit(float(n)) if metric == "cov" else F.lit(1e0)
    s = F.col("ac") + F.col("missing") * fill if metric == "cov" else F.col("entries").cast("double")
    return found.select(*VARIANT, s.alias("s"), fill.alias("fill"), "g")


def variant_sums(cols: DataFrame, n: int, *keys: str) -> DataFrame:
    """``(keys, chrom, pos, variant, s)``, one row a variant."""
    rows = cols.select(*keys, *VARIANT, "s")
    return rows.distinct() if n > ROW else rows


def entries(cols: DataFrame, metric: str, *keys: str) -> DataFrame:
    """``(keys, chrom, pos, variant, sample[, hap], x)``."""
    x = F.coalesce("e.dosage", "fill") if metric == "cov" else F.lit(1e0)
    inner = [f.name for f in cols.schema["g"].dataType.elementType.fields[:-1]]
    rows = cols.select(*keys, *VARIANT, "fill", F.explode("g").alias("e"))
    return rows.select(*keys, *VARIANT, *[f"e.{c}" for c in inner], x.cast("double").alias("x"))


def value(metric: str, n: int, s1: Column, s2: Column, s12: Column) -> Column:
    """The metric from two sums and the sum of products over n haplotypes or samples; null where a variant doesn't vary."""
    n_ = F.lit(float(n))
    if metric == "cov":
        return s12 / n_ - s1 * s2 / (n_ * n_)
    if metric == "rsquare_approx":
        f1, f2 = s1 / n_, s2 / n_
        d = s12 / n_ - f1 * f2
        return F.try_divide(d * d, f1 * (1 - f1) * f2 * (1 - f2))
    if metric == "dprime":
        f1, f2 = s1 / n_, s2 / n_
        d = s12 / n_ - f1 * f2
        return F.try_divide(d, F.when(d < 0, F.least(f1 * f2, (1 - f1) * (1 - f2))).otherwise(F.least(f1 * (1 - f2), f2 * (1 - f1))))
    r = F.try_divide(n_ * s12 - s1 * s2, F.sqrt(s1 * s2 * (n_ - s1) * (n_ - s2)))
    return r if metric == "r" else r * r


def _order(diagonal: bool) -> Column:
    first, second = F.struct("pos1", "variant1"), F.struct("pos2", "variant2")
    return first <= second if diagonal else first < second


def _side(rows: DataFrame, i: int, *keep: str) -> DataFrame:
    return rows.select("chrom", *keep, *[F.col(c).alias(f"{c}{i}") for c in ("pos", "variant", "s", "x") if c in rows.columns])


def paired(sums: DataFrame, diagonal: bool, cells: DataFrame | None = None, size: int = 1) -> DataFrame:
    """``(chrom, pos1, variant1, s1, pos2, variant2, s2)`` of variants alone.

    Given cells (``chrom, i, j``), a variant meets those of the
    segments that its own has a cell with. Else each variant goes to a row and a column of a square
    of blocks, so every pair meets in one block of the square and no task holds them all.
    """
    if cells is not None:
        a = _side(sums, 1).withColumn("i", segment(F.col("pos1"), size)).join(cells.select("chrom", "i", "j"), ["chrom", "i"])
        b = _side(sums, 2).withColumn("j", segment(F.col("pos2"), size))
        return a.join(b, ["chrom", "j"]).where(_order(diagonal)).drop("i", "j")
    own, every = F.pmod(F.xxhash64("variant"), F.lit(BLOCKS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    a = _side(sums.withColumn("row", own).withColumn("column", every), 1, "row", "column")
    b = _side(sums.withColumn("column", own).withColumn("row", every), 2, "row", "column")
    return a.join(b, ["row", "column", "chrom"]).where(_order(diagonal)).drop("row", "column")


def products(cols: DataFrame, metric: str, diagonal: bool) -> DataFrame:
    """Sums of products of the pairs that share a haplotype or sample."""
    rows = entries(cols, metric)
    on = unit(rows)
    both = _side(rows, 1, *on).join(_side(rows, 2, *on), [*on, "chrom"]).where(_order(diagonal))
    return both.groupBy("chrom", "pos1", "variant1", "pos2", "variant2").agg(F.sum(F.col("x1") * F.col("x2")).alias("s12"))


def _valued(pairs: DataFrame, both: DataFrame, metric: str, n: int) -> DataFrame:
    names = ["chrom", "pos1", "variant1", "pos2", "variant2"]
    return pairs.join(both, names, "left").select(*names, value(metric, n, F.col("s1"), F.col("s2"), F.coalesce("s12", F.lit(0e0))).alias("value"))


#: Variants of a group are dealt into blocks of so many (about), and pairs are formed from a variant and a block.
GROUP_BLOCK = 4096


def numbered_members(members: DataFrame) -> DataFrame:
    """``(group, chrom, block, blocks, k, pos, variant)``: members dealt into blocks by hash, with their places in order of position and name in the block."""
    own = ["group", "chrom"]
    sizes = members.groupBy(*own).agg(F.ceil(F.count("*") / F.lit(GROUP_BLOCK)).cast("int").alias("blocks"))
    dealt = members.join(sizes, own).withColumn("block", F.pmod(F.xxhash64("pos", "variant"), F.col("blocks")).cast("int"))
    held = dealt.groupBy(*own, "block", "blocks").agg(F.array_sort(F.collect_list(F.struct("pos", "variant"))).alias("v"))
    return held.select(*own, "block", "blocks", F.posexplode("v").alias("k", "v")).select(*own, "block", "blocks", "k", "v.pos", "v.variant")


def group_pairs(cols: DataFrame, groups: DataFrame, n: int, metric: str, diagonal: bool) -> DataFrame:
    """``(group, chrom, pos1, variant1, pos2, variant2, value)`` of all pairs within a group, small groups whole and others by blocks."""
    own = ["group", "chrom"]
    members = groups.select("group", *VARIANT).where("group is not null").distinct()
    counted = cols.select(*VARIANT, F.size("g").alias("entries")).join(members, list(VARIANT)).groupBy(*own).agg(F.count("*").alias("m"), F.sum("entries").alias("entries"))
    sized = members.join(counted.select(*own, ((F.col("m") <= MEMBERS) & (F.col("entries") <= ENTRIES)).alias("small")), own)
    few, many = (sized.where(c).drop("small") for c in ("small", "not small"))
    keys = [f.name for f in cols.schema["g"].dataType.elementType.fields[:-1]]
    pairs = whole_pairs(cols.join(few, list(VARIANT)), keys, metric, diagonal)
    small = pairs.select(*own, "pos1", "variant1", "pos2", "variant2", value(metric, n, F.col("s1"), F.col("s2"), F.col("s12")).alias("value"))
    return block_pairs(cols, many, n, metric, diagonal).unionByName(small)


def block_pairs(cols: DataFrame, groups: DataFrame, n: int, metric: str, diagonal: bool) -> DataFrame:
    """``group_pairs`` of large groups; pairs themselves are never shuffled.

    What is shuffled are entries, the sums of pairs that share a haplotype or sample, by places in blocks instead of names, and a row for
    each variant and block of its group. A row has its sums of products as one array by the block's places; then the block's variants are
    generated beside it, so a pair is made where it is given out, however large a group is.
    """
    own = ["group", "chrom"]
    cols = cols.join(numbered_members(groups), list(VARIANT))
    sums = variant_sums(cols, n, "group", "block", "blocks", "k")
    blocks = sums.groupBy(*own, "block", "blocks").agg(F.array_sort(F.collect_list(F.struct("k", "pos", "s"))).alias("v"), F.array_sort(F.collect_list(F.struct("k", "variant"))).alias("names"))

    rows = entries(cols, metric, "group", "block", "k")
    carried = rows.groupBy(*own, *unit(rows)).agg(F.collect_list(F.struct("block", "k", "x")).alias("e"))
    one = carried.select(*own, "e", F.inline("e").alias("block1", "k1", "x1"))
    both = one.select(*own, "block1", "k1", "x1", F.inline("e").alias("block2", "k2", "x2"))
    after = (F.col("k1") <= F.col("k2")) if diagonal else (F.col("k1") < F.col("k2"))
    both = both.where((F.col("block1") < F.col("block2")) | (F.col("block1") == F.col("block2")) & after)
    shared = both.groupBy(*own, "block1", "block2", "k1", "k2").agg(F.sum(F.col("x1") * F.col("x2")).alias("s12"))
    shared = shared.groupBy(*own, "block1", "block2", "k1").agg(F.array_sort(F.collect_list(F.struct("k2", "s12"))).alias("e"))

    each = blocks.select(*own, F.col("block").alias("block1"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block2"), "v", "names")
    each = each.select(*own, "block1", "block2", "names", F.inline("v").alias("k1", "pos_a", "s_a"))
    each = each.select(*own, "block1", "block2", "k1", "pos_a", "s_a", F.get("names", F.col("k1"))["variant"].alias("variant_a"))
    spark = cols.sparkSession
    # a number of partitions of its own: a row here gives a block of pairs, so sizes of rows say nothing of the work. Two blocks are a key, so a large
    # group is dealt evenly; as one column, of which no constant (a single chromosome) is taken out, so that the join keeps these partitions
    two, cell = [*own, "block1", "block2"], F.concat_ws(" ", "block1", "block2", F.length("chrom"), "chrom", F.col("group").cast("string")).alias("cell")
    each = each.join(shared, [*two, "k1"], "left").withColumn("cell", cell).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell")
    others = blocks.select(*own, F.col("block").alias("block2"), F.explode(F.sequence(F.lit(0), "block")).alias("block1"), "v", "names")
    met = each.join(others.select(cell, "v", "names"), "cell")
    before = lambda t: F.coalesce(F.get("e", t - 1)["k2"], F.lit(-1))
    at_places = F.flatten(F.transform("e", lambda x, t: F.concat(F.array_repeat(F.lit(0e0), x["k2"] - F.when(t > 0, before(t)).otherwise(-1) - 1), F.array(x["s12"]))))
    met = met.select(*two, "k1", "pos_a", "variant_a", "s_a", at_places.alias("s12"), "v", "names")
    pairs = met.select(*two, "k1", "pos_a", "variant_a", "s_a", "s12", "names", F.inline("v").alias("k2", "pos_b", "s_b"))
    pairs = pairs.where((F.col("block1") < F.col("block2")) | after)
    # names are looked up by their places, and not at all where a query doesn't give them out
    name = F.get("names", F.col("k2"))["variant"]
    first = (F.col("pos_a") < F.col("pos_b")) | (F.col("pos_a") == F.col("pos_b")) & (F.col("variant_a") <= name)
    named = [
        F.least("pos_a", "pos_b").alias("pos1"),
        F.when(first, F.col("variant_a")).otherwise(name).alias("variant1"),
        F.greatest("pos_a", "pos_b").alias("pos2"),
        F.when(first, name).otherwise(F.col("variant_a")).alias("variant2"),
    ]
    return pairs.select(*own, *named, value(metric, n, F.col("s_a"), F.col("s_b"), F.coalesce(F.get("s12", F.col("k2")), F.lit(0e0))).alias("value"))


def region_pairs(calls: DataFrame, n: int, metric: str = "rsquare", diagonal: bool = False, groups: DataFrame | None = None, cells: DataFrame | None = None, size: int = 1) -> DataFrame:
    """``([group,] chrom, pos1, variant1, pos2, variant2, value)`` for all pairs in order of position, then name.

    ``n``: haplotypes (samples for covariances) of the chosen subset. With ``groups(group, chrom, pos, variant)``
    only pairs within one; with ``cells(chrom, i, j)`` only pairs of segments of ``size`` that have a cell.
    """
    cols = columns(calls, n, metric)
    if groups is not None:
        return group_pairs(cols, groups, n, metric, diagonal)
    return _valued(paired(variant_sums(cols, n), diagonal, cells, size), products(cols, metric, diagonal), metric, n)


def index_pairs(calls: DataFrame, index: DataFrame, n: int, metric: str = "rsquare") -> DataFrame:
    """One variant against all of ``calls``, itself included if it is among them.

    ``index``: the calls of that variant alone, which may lie outside the region; on another chromosome
    it gives no rows.
    """
    cols, own = columns(calls, n, metric), columns(index, n, metric)
    one = variant_sums(own, n).select("chrom", F.col("pos").alias("index_pos"), F.col("variant").alias("index_variant"), F.col("s").alias("s1"))
    carriers = entries(own, metric)
    on = ["chrom", *unit(carriers)]
    both = entries(cols, metric).join(carriers.select(*on, F.col("x").alias("x1")), on).groupBy(*VARIANT).agg(F.sum(F.col("x") * F.col("x1")).alias("s12"))
    # one row, that of the index variant
    out = variant_sums(cols, n).withColumnRenamed("s", "s2").join(F.broadcast(one), "chrom").join(both, list(VARIANT), "left")
    return out.select("index_variant", "index_pos", *VARIANT, value(metric, n, F.col("s1"), F.col("s2"), F.coalesce("s12", F.lit(0e0))).alias("value"))


def _multiply(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Products of the columns of two blocks over one part of the samples."""
    chrom, i, j, _ = key
    left, right = rows[rows["block"] == i], rows[rows["block"] == j]
    who, place = np.unique(np.concatenate([*left["units"], *right["units"]]), return_inverse=True)

    def matrix(part: pd.DataFrame, at: np.ndarray) -> np.ndarray:
        m = np.zeros((len(part), len(who)))
        m[np.repeat(np.arange(len(part)), part["units"].map(len)), at] = np.concatenate(part["xs"].to_numpy())
        return m

    split = int(left["units"].map(len).sum())
    out = matrix(left, place[:split]) @ matrix(right, place[split:]).T
    p, q = np.nonzero(out)
    names = {f"{c}{k}": side[c].to_numpy()[at] for k, side, at in ((1, left, p), (2, right, q)) for c in ("pos", "variant")}
    return pd.DataFrame({"chrom": chrom, **names, "part": out[p, q]})


#: Bytes of the two matrices and the product that a task of ``dense_pairs`` holds.
TILE_BYTES = 64 << 20


def tiles(n_variants: int, n: int, limit: int = TILE_BYTES) -> tuple[int, int]:
    """Blocks of variants and parts of the samples, so that a task's matrices hold ``limit`` bytes at most on average.

    A tile multiplies v variants by v over u samples: 8 (2 v u + v v) bytes. Every part of the samples gives its own sums to add up, so parts are
    as large as blocks of ``least`` variants leave room for; then blocks are as large as these parts do.
    """
    least = 64
    u = min(max(n, 1), max(1, (limit // 8 - least * least) // (2 * least)))
    v = max(1, int((u * u + limit / 8) ** 0.5 - u))
    return max(1, -(-n_variants // v)), max(1, -(-n // u))


def dense_pairs(calls: DataFrame, n: int, metric: str = "rsquare", blocks: int | None = None, parts: int | None = None, diagonal: bool = False, cells: DataFrame | None = None, size: int = 1) -> DataFrame:
    """The same rows as ``region_pairs``, with ``cells`` those of their pairs, by matrix products of blocks of variants, each two blocks once.

    Variants are dealt into ``blocks`` and samples into ``parts`` by hash; a task multiplies two
    blocks over one part, so it holds two matrices of (variants / blocks) x (samples / parts) numbers. What isn't given is planned by ``tiles`` from
    the number of variants, which one small job counts.
    """
    if blocks is None or parts is None:
        planned = tiles(calls.select(*VARIANT).distinct().count(), n)
        blocks, parts = blocks or planned[0], parts or planned[1]
    cols = columns(calls, n, metric)
    rows = entries(cols, metric)
    who = F.xxhash64(*unit(rows))
    dealt = rows.select(*VARIANT, who.alias("who"), F.pmod(who, F.lit(parts)).cast("int").alias("piece"), "x").groupBy(*VARIANT, "piece").agg(F.collect_list(F.struct("who", "x")).alias("e"))
    blocked = dealt.select(*VARIANT, "piece", F.pmod(F.xxhash64("variant"), F.lit(blocks)).cast("int").alias("block"), F.col("e.who").alias("units"), F.col("e.x").alias("xs"))
    squares = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def multiply(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        if not ((part["block"] == key[1]).any() and (part["block"] == key[2]).any()):
            return pd.DataFrame(columns=["chrom", "pos1", "variant1", "pos2", "variant2", "part"])
        return _multiply(key, part)

    made = squares.groupBy("chrom", "i", "j", "piece").applyInPandas(multiply, "chrom string, pos1 long, variant1 string, pos2 long, variant2 string, part double")
    # blocks are unordered, so a product may come the other way round; a block with itself gives both ways
    turned = made.unionByName(made.select("chrom", F.col("pos2").alias("pos1"), F.col("variant2").alias("variant1"), F.col("pos1").alias("pos2"), F.col("variant1").alias("variant2"), "part")).where(_order(diagonal))
    block = [F.pmod(F.xxhash64(f"variant{k}"), F.lit(blocks)) for k in (1, 2)]
    share = F.when(block[0] == block[1], F.col("part") / 2).otherwise(F.col("part"))
    both = turned.groupBy("chrom", "pos1", "variant1", "pos2", "variant2").agg(F.sum(share).alias("s12"))
    return _valued(paired(variant_sums(cols, n), diagonal, cells, size), both, metric, n)


def carried_share(calls: DataFrame, n: int) -> float:
    """Mean share of haplotypes or samples that carry a variant or miss its call; one small job."""
    row = calls.groupBy(*VARIANT).agg(F.count("*").alias("m")).agg(F.avg("m").alias("m")).first()
    return (row["m"] or 0.0) / n if n else 0.0


def region(calls: DataFrame, n: int, chrom: str, start: int, stop: int, metric: str = "rsquare", diagonal: bool = False, dense: bool | None = False) -> DataFrame:
    """All pairs of a region. ``dense``: multiply blocks; null decides by the share of carriers."""
    inside = in_region(calls, chrom, start, stop)
    if dense is None:
        dense = carried_share(inside, n) >= DENSE
    return dense_pairs(inside, n, metric, diagonal=diagonal) if dense else region_pairs(inside, n, metric, diagonal)


def index_calls(calls: DataFrame, index: str, chrom: str) -> tuple[DataFrame, str, int]:
    """Calls of the index variant, its name and position; both notations are read, anything else is an error."""
    at, pos, ref, alt = identifier(index)
    name = f"{at}:{pos}_{ref}/{alt}"
    own = calls.where((F.col("chrom") == at) & (F.col("chrom") == chrom) & (F.col("pos") == pos) & (F.col("variant") == name))
    return own, name, pos


def variant(calls: DataFrame, n: int, index: str, chrom: str, start: int, stop: int, metric: str = "rsquare") -> DataFrame:
    """``index``: ``chrom:pos_ref/alt`` or ``chrom:pos:ref:alt``; on another chromosome there are no rows."""
    own, _, _ = index_calls(calls, index, chrom)
    return index_pairs(in_region(calls, chrom, start, stop), own, n, metric)
