"""Interval joins against all pairs of intervals; stored cells against computed ones."""

import random
from collections import Counter

import pytest

from alleloom.operators import intervals
from alleloom.plans import paging, service
from alleloom.plans.cellstore import CellStore
from alleloom.sources import files


def lengths(r):
    return r.choice([0, 1, 500, 1023, 1024, 9_000, 70_000, 5_000_000, 300_000_000])


def test_overlaps_are_those_of_all_pairs(spark):
    r = random.Random(1)

    def some(n):
        out = []
        for k in range(n):
            a = r.choice([r.randrange(0, 3_000), r.randrange(0, 400_000_000)])
            out.append((r.choice(["1", "2", None]), a, r.choice([a + lengths(r), None, a - 1] if k % 9 == 0 else [a + lengths(r)]), k))
        return [*out, out[0], out[0]]

    left, right = some(150), some(200)
    a, b = spark.createDataFrame(left, "chrom string, start long, stop long, k long"), spark.createDataFrame(right, "chrom string, first long, last long, m long")
    found = intervals.overlaps(a, b, right_bounds=("first", "last"))
    assert found.columns == ["chrom", "start", "stop", "k", "first", "last", "m"]
    ok = lambda x: x[0] is not None and x[2] is not None and x[1] <= x[2]
    want = Counter((*x, *y[1:]) for x in left for y in right if ok(x) and ok(y) and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert Counter(map(tuple, found.collect())) == want and len(want) > 500
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    points = spark.createDataFrame([(c, p) for c, p, *_ in right if c], "chrom string, pos long")
    got = Counter(map(tuple, intervals.overlaps(a, points).select("k", "pos").collect()))
    assert got == Counter((x[3], y[1]) for x in left for y in right if ok(x) and x[0] == y[0] and x[1] <= y[1] <= x[2])


def test_bins_of_intervals_are_parted_and_only_where_needed(spark):
    """a wide bin is dealt into parts, and points go to no level that the other side lacks."""
    points = spark.range(5_000).selectExpr("'1' as chrom", "id as pos")
    short = spark.createDataFrame([("1", 10, 50)], "chrom string, start long, stop long")
    long = spark.createDataFrame([("1", 0, 6_000_000)], "chrom string, start long, stop long")
    binned = lambda other: intervals._bins(points, "chrom", "pos", "pos", "every", intervals._own_levels(other, "chrom", "start", "stop"))
    assert binned(short).count() == 5_000
    wide = binned(long).groupBy("_level", "_bin", "_part").count().collect()
    assert len(wide) > 16 and max(r["count"] for r in wide) < 500
    assert intervals.overlaps(long, points).count() == 5_000 and intervals.overlaps(short, points).count() == 41


def test_cells_of_many_segments_come_in_blocks(spark, monkeypatch):
    """no row holds all segments of a chromosome."""
    monkeypatch.setattr(paging, "CELL_BLOCK", 5)
    places = spark.createDataFrame([(c, p) for c in ("1", "2") for p in range(0, 600, 7)] + [("1", 3)], "chrom string, pos long")
    cells = paging.allowed_cells(places, 20)
    assert cells.columns == ["chrom", "i", "j", "cell"]
    assert Counter((r["chrom"], r["i"], r["j"]) for r in cells.collect()) == Counter((c, i, j) for c in ("1", "2") for j in range(30) for i in range(j + 1))


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    r = random.Random(4)
    head = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"s{k}" for k in range(30)]]
    rows = [["1", str(p), ".", "A", "C", ".", ".", ".", "GT", *[r.choice(["0|0", "0|1", "1|1", "1|0"]) for _ in range(30)]] for p in range(5, 400, 12)]
    path = tmp_path_factory.mktemp("vcf") / "a.vcf"
    path.write_text("\n".join("\t".join(x) for x in [head, *rows]) + "\n")
    calls = files.open_genotypes(spark, str(path), haplotypes=True).cache()
    return service.Genotypes(calls, files.same_samples(spark, [str(path)]), segment=30)


def rows_of(df):
    return [(r["pos1"], r["pos2"], None if r["value"] is None else round(r["value"], 9)) for r in df.collect()]


def test_regions_share_stored_cells(spark, dataset, tmp_path, monkeypatch):
    store = CellStore(spark, str(tmp_path / "cells"))
    kept = dataset.kept(store, "d")
    computed = []
    inner = paging.ld.region_pairs

    def counted(calls, n, metric="rsquare", diagonal=False, groups=None, cells=None, size=1):
        computed.append(sorted((c["i"], c["j"]) for c in cells.collect()))
        return inner(calls, n, metric, diagonal, groups, cells, size)

    want = {k: rows_of(dataset.region_ld("1", *k, "rsquare")) for k in ((50, 190), (100, 300), (95, 140))}
    monkeypatch.setattr(paging.ld, "region_pairs", counted)
    assert rows_of(kept.region_ld("1", 50, 190, "rsquare")) == want[50, 190] and len(computed) == 1
    assert rows_of(kept.region_ld("1", 100, 300, "rsquare")) == want[100, 300] and len(computed) == 2
    assert not set(computed[0]) & set(computed[1])  # the cells of both were stored by the first
    assert rows_of(kept.region_ld("1", 95, 140, "rsquare")) == want[95, 140] and len(computed) == 2
    assert rows_of(kept.region_ld("1", 95, 140, "rsquare", diagonal=True)) != want[95, 140] and len(computed) == 2
    names = {"dataset": "d", "subset": "ALL", "metric": "rsquare", "chrom": "1", "size": 30}
    assert sorted((r["i"], r["j"]) for r in store.stored(**names).collect()) == sorted(computed[0] + computed[1])


def test_results_never_mix(spark, dataset, tmp_path):
    store = CellStore(spark, str(tmp_path / "cells"))
    kept = dataset.kept(store, "d")
    some = spark.createDataFrame([(f"s{k}",) for k in range(12)], "sample string")
    for metric in ("rsquare", "r", "cov", "dprime"):
        assert rows_of(kept.region_ld("1", 0, 150, metric)) == rows_of(dataset.region_ld("1", 0, 150, metric))
    named, plain = kept.of(some, "few"), dataset.of(some)
    assert rows_of(named.region_ld("1", 0, 150, "r")) == rows_of(plain.region_ld("1", 0, 150, "r")) != rows_of(kept.region_ld("1", 0, 150, "r"))
    assert kept.of(some).store is None and rows_of(kept.kept(None, "").region_ld("1", 0, 150, "r")) == rows_of(kept.region_ld("1", 0, 150, "r"))


def test_pages_of_stored_cells_join_to_the_whole(spark, dataset, tmp_path):
    kept = dataset.kept(CellStore(spark, str(tmp_path / "cells")), "d")
    whole, got, after = rows_of(dataset.region_ld("1", 0, 200, "r")), [], None
    while True:
        rows = kept.region_ld("1", 0, 200, "r", limit=50, after=after).collect()
        got += [(r["pos1"], r["pos2"], round(r["value"], 9)) for r in rows]
        after = paging.next_cursor(rows, paging.PAIR_ORDER, 50, after)
        if after is None:
            break
    assert got == whole


def test_a_batch_without_a_manifest_counts_for_nothing(spark, dataset, tmp_path, monkeypatch):
    store = CellStore(spark, str(tmp_path / "cells"))
    kept, want = dataset.kept(store, "d"), rows_of(dataset.region_ld("1", 0, 100, "r"))

    def fails(*a):
        raise OSError("lost")

    monkeypatch.setattr(CellStore, "_publish", fails)
    with pytest.raises(OSError):
        kept.region_ld("1", 0, 100, "r")
    names = {"dataset": "d", "subset": "ALL", "metric": "r", "chrom": "1", "size": 30}
    assert store.stored(**names).count() == 0
    monkeypatch.undo()
    assert rows_of(kept.region_ld("1", 0, 100, "r")) == want
    # two writers stored the same cells: each cell is read from one batch
    cells = store.stored(**names).select("i", "j")
    again = store.spark.read.parquet(f"{store._folder(names)}/pairs/*")
    again.write.parquet(f"{store._folder(names)}/pairs/other")
    store._publish(store._folder(names), "other", cells)
    assert rows_of(kept.region_ld("1", 0, 100, "r")) == want
