"""Every registered query gives the rows of its SQL."""

import pytest
from compare import same_rows
from conftest import DATA
from pyspark.sql import functions as F

import __spark_entry__
from alleloom.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_of_the_sql(spark, name):
    same_rows(QUERIES[name](spark, DATA), ORACLES[name], DATA)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["pos1", "pos2", "value"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _group_calls(spark, carriers: int):
    """40 variants of one group, each carried by the next ``carriers`` of 60 samples; every 11th call is missing."""
    rows = [("1", p, f"1:{p}_A/T", (p + i) % 60, None if (p * 7 + i) % 11 == 0 else 1.0 + (p + i) % 2) for p in range(40) for i in range(carriers)]
    calls = spark.createDataFrame(rows, "chrom string, pos long, variant string, sample long, dosage double")
    return calls, calls.select(F.lit("g").alias("group"), "chrom", "pos", "variant").distinct()


@pytest.mark.parametrize("carriers", [2, 45])
@pytest.mark.parametrize("diagonal", [True, False])
def test_pairs_of_groups_over_several_blocks(spark, monkeypatch, carriers, diagonal):
    """pairs of a group's blocks, sparse and dense, are those of comparing all with all."""
    from alleloom.operators import ld

    monkeypatch.setattr(ld, "GROUP_BLOCK", 7)
    calls, groups = _group_calls(spark, carriers)
    key = lambda r: (r["pos1"], r["variant1"], r["pos2"], r["variant2"])
    got = {key(r): r["value"] for r in ld.region_pairs(calls, 60, "cov", diagonal, groups).collect()}
    assert len(got) == (820 if diagonal else 780)
    want = {key(r): r["value"] for r in ld.region_pairs(calls, 60, "cov", diagonal).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_pairs_of_groups_are_not_shuffled(spark, monkeypatch):
    """what the exchanges of a group's pairs hold is far from the number of pairs, which grows with the square of the group."""
    import re

    from alleloom.operators import ld, score

    calls, groups = _group_calls(spark, 2)
    pairs = ld.region_pairs(calls, 60, "cov", True, groups)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate inline\(v", plan) and plan.index("Generate inline(v") < plan.index("Join ")  # made above all joins
    # the groups' members are filtered before pairs are made of them
    kept = score.surviving_groups(groups, calls.where("pos < 5").select("chrom", "pos", "variant"))
    assert {r["pos"] for r in kept.collect()} == set(range(5))


def test_pairs_of_a_large_group_are_dealt_by_two_blocks(spark, monkeypatch):
    """a block is not one task for all the blocks that it meets, on one chromosome (a constant) or without broadcast tables."""
    from alleloom.operators import ld

    monkeypatch.setattr(ld, "GROUP_BLOCK", 7)
    monkeypatch.setattr(ld, "MEMBERS", 0)
    calls, groups = _group_calls(spark, 2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        fixed = [df.withColumn("chrom", F.lit("1")) for df in (calls, groups)]
        pairs = ld.region_pairs(fixed[0], 60, "cov", True, fixed[1])
        used = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in used) == 820 and len(used) > 6  # of six blocks


def test_calls_of_variants_that_are_filtered_out_are_not_gathered(spark):
    """of the calls, those of surviving variants alone are collected into rows of a variant."""
    lines = QUERIES["group_filter_pvalue"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    at = [i for i, x in enumerate(lines) if "Aggregate" in x and "collect_list(struct(sample" in x]
    assert at
    for i in at:
        below = [x for k, x in enumerate(lines) if k > i and all(d > depth[i] for d in depth[i + 1 : k + 1])]
        assert any("Join LeftSemi" in x for x in below)


def test_rounding_without_decimals_is_the_same(spark):
    """the values of pairs, rounded in doubles, are those of ``round`` to the last bit, near ties, very large and beyond numbers too."""
    import random
    import struct

    from alleloom.functions.variants import rounded_fast

    r = random.Random(1)
    values = [r.uniform(-1, 1) * 10 ** r.randint(-14, 9) for _ in range(4000)] + [r.randrange(-(10**9), 10**9) / 1e9 for _ in range(2000)]
    values += [(2 * k + 1) / 2e8 for k in range(-500, 500)] + [0.0, -0.0, -4e-9, 4e-9, 5e-9, -5e-9, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(rounded_fast(F.col("v"), 8).alias("a"), F.round("v", 8).alias("b")).collect()
    assert len(rows) == len(values)
    assert [x for x in rows if (x["a"] is None) != (x["b"] is None) or x["a"] is not None and struct.pack("d", x["a"]) != struct.pack("d", x["b"])] == []


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("metric", ["cov", "rsquare"])
def test_small_and_large_groups_give_the_pairs_of_all_with_all(spark, monkeypatch, metric, diagonal):
    """groups taken whole, some of them together or over several rows a variant, and groups dealt into blocks."""
    from alleloom.operators import ld, whole_groups

    calls, _ = _group_calls(spark, 20)
    if metric != "cov":
        calls = calls.withColumn("hap", F.col("sample") % 2).withColumn("sample", F.concat(F.lit("s"), F.floor(F.col("sample") / 2).cast("string")))
    named = F.explode(F.array(F.floor(F.col("pos") / 7).cast("string"), F.lit("all")))  # 6 groups of 7 or fewer, and one of 40
    groups = calls.select(named.alias("group"), "chrom", "pos", "variant").distinct()
    want = {(r["pos1"], r["pos2"]): r["value"] for r in ld.region_pairs(calls, 60, metric, diagonal).collect()}
    monkeypatch.setattr(ld, "MEMBERS", 90)
    monkeypatch.setattr(ld, "ROW", 7)  # variants of over 7 calls have several rows
    got = [(r["group"], r["pos1"], r["pos2"], r["value"]) for r in ld.region_pairs(calls, 60, metric, diagonal, groups).collect()]
    assert sorted(x[:3] for x in got) == sorted((g, a, b) for a, b in want for g in ("all", *([str(a // 7)] if a // 7 == b // 7 else [])))
    assert all(abs((v or 0) - (want[a, b] or 0)) < 1e-12 for _, a, b, v in got)
    # groups that come in many batches, taken together by few entries
    monkeypatch.setattr(whole_groups, "TOGETHER", 30)
    import pyarrow as pa

    table = pa.table({"group": ["a", "a", "b", "b", "b", "c"], "chrom": ["1"] * 6, "pos": [1, 2, 1, 1, 3, 1], "variant": list("uvuuwu"), "s": [1.0, 2, 3, 3, 4, 5], "sample": [[1, 2], [2] * 1, [1], [4], [1, 4], [9]], "x": [[1.0, 2], [3.0], [1.0], [5.0], [2.0, 2], [1.0]]})
    for size in (1, 2, 6):
        rows = [r for b in whole_groups.whole(iter(table.to_batches(size)), ["sample"], True) for r in b.to_pylist()]
        assert [(r["group"], r["pos1"], r["pos2"], r["s12"]) for r in rows] == [("a", 1, 1, 5), ("a", 1, 2, 6), ("a", 2, 2, 9), ("b", 1, 1, 26), ("b", 1, 3, 12), ("b", 3, 3, 8), ("c", 1, 1, 1)]


def test_positions_of_covariances_read_the_rows_once(spark):
    """the rows of a covariance file are not computed twice."""
    from alleloom.sources import files

    cov = spark.createDataFrame([("1", 5, "5,7,x"), ("1", 7, None), ("2", 5, "6"), (None, 4, "4")], "chrom string, pos long, positions string")
    assert files.covariance_positions(cov) == 4
    plan = []
    real = type(cov).count
    patch = pytest.MonkeyPatch()
    with patch.context() as m:
        m.setattr(type(cov), "count", lambda self: plan.append(self._jdf.queryExecution().optimizedPlan().toString()) or real(self))
        files.covariance_positions(cov)
    assert plan[0].count("LogicalRDD") == 1
