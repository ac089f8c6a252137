"""Packed haplotypes, rows of large cohorts and planned tiles against numpy."""

import numpy as np
import pytest

from alleloom.errors import QueryError
from alleloom.operators import bitset, ld

METRICS = ("r", "rsquare", "rsquare_approx", "dprime")


@pytest.fixture(scope="module")
def cohort(spark):
    """12 variants over 1,300 samples; some haplotypes missing, one variant that nobody carries, one that all do."""
    r = np.random.default_rng(3)
    share = np.array([0.001, 0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.2, 0.2, 0.05, 0.0, 1.0])
    h = (r.random((12, 1300, 2)) < share[:, None, None]).astype(float)
    h[8] = np.where(r.random((1300, 2)) < 0.9, h[7], h[8])
    h[3:6][r.random((3, 1300, 2)) < 0.02] = np.nan
    rows = [("1", 10 * i, f"1:{10 * i}_A/C", f"s{j}", k, None if np.isnan(v) else float(v)) for i, x in enumerate(h) for (j, k), v in np.ndenumerate(x) if v != 0]
    calls = spark.createDataFrame(rows, "chrom string, pos long, variant string, sample string, hap int, dosage double").repartition(8).cache()
    samples = spark.createDataFrame([(f"s{j}",) for j in range(1300)], "sample string")
    return h, calls, samples


def expected(h, metric, diagonal):
    x = np.where(np.isnan(h), 1, h).reshape(len(h), -1)
    out = {}
    for i in range(len(h)):
        for j in range(i if diagonal else i + 1, len(h)):
            a, b = x[i], x[j]
            if not np.nansum(h[i]) or not np.nansum(h[j]):
                continue
            f1, f2, d = a.mean(), b.mean(), (a * b).mean() - a.mean() * b.mean()
            v = (f1 * (1 - f1) * f2 * (1 - f2)) ** 0.5
            most = min(f1 * f2, (1 - f1) * (1 - f2)) if d < 0 else min(f1 * (1 - f2), f2 * (1 - f1))
            out[10 * i, 10 * j] = None if v == 0 else {"r": d / v, "rsquare": (d / v) ** 2, "rsquare_approx": (d / v) ** 2, "dprime": d / most if most else None}[metric]
    return out


def same(df, want):
    got = {(r["pos1"], r["pos2"]): r["value"] for r in df.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, abs=1e-9)), (k, got[k], v)


@pytest.mark.parametrize("metric", METRICS)
def test_words_count_what_numpy_counts(cohort, monkeypatch, metric):
    h, calls, samples = cohort
    for bucket in (bitset.BUCKET, 600):
        monkeypatch.setattr(bitset, "BUCKET", bucket)
        bits = bitset.packed(calls, bitset.numbered(samples, 2600))
        same(bitset.region_pairs(bits, 2600, metric, metric == "r"), expected(h, metric, metric == "r"))


def test_places_are_all_different(spark, cohort, monkeypatch):
    _, _, samples = cohort
    monkeypatch.setattr(bitset, "BUCKET", 600)
    at = bitset.numbered(samples, 2600).collect()
    assert len({(x["chunk"], x["word"], x["bit"]) for x in at}) == len({(x["sample"], x["hap"]) for x in at}) == 2600
    assert all(0 <= x["bit"] < 64 and 0 <= x["word"] < bitset.WORDS for x in at)


def test_no_row_holds_the_cohort(cohort):
    """A common variant has a row for each chunk of 512 haplotypes, in plans without Python."""
    _, calls, samples = cohort
    bits = bitset.packed(calls, bitset.numbered(samples, 2600))
    rows = bits.where("pos = 110").collect()
    assert len(rows) >= 2600 // bitset.CHUNK and sum(int(x[f"w{k}"]).bit_count() if x[f"w{k}"] >= 0 else 64 - (~int(x[f"w{k}"])).bit_count() for x in rows for k in range(bitset.WORDS)) == 2600
    plan = bitset.region_pairs(bits, 2600)._jdf.queryExecution().toString()
    assert "Python" not in plan and "collect_list" not in plan and "bit_count" in plan


def test_packing_needs_haplotypes(cohort):
    _, calls, samples = cohort
    with pytest.raises(QueryError):
        bitset.packed(calls.drop("hap"), bitset.numbered(samples, 2600))
    with pytest.raises(QueryError):
        bitset.region_pairs(bitset.packed(calls, bitset.numbered(samples, 2600)), 2600, "cov")
    assert bitset.region_pairs(bitset.packed(calls.where("false"), bitset.numbered(samples, 2600)), 2600).count() == 0


def test_large_cohorts_have_several_rows_a_variant(cohort, monkeypatch):
    h, calls, samples = cohort
    monkeypatch.setattr(ld, "ROW", 500)
    cols = ld.columns(calls, 2600, "rsquare")
    assert cols.selectExpr("max(size(g)) as m").first()["m"] < 700 and cols.where("pos = 110").count() == 6
    same(ld.region_pairs(calls, 2600, "rsquare"), expected(h, "rsquare", False))
    same(ld.dense_pairs(calls, 2600, "rsquare"), expected(h, "rsquare", False))
    one = {r["pos"]: r["value"] for r in ld.variant(calls, 2600, "1:70_A/C", "1", 0, 200, "r").collect()}
    want = expected(h, "r", True)
    assert one.keys() == {p for k in want for p in k} and all(one[p] == (None if v is None else pytest.approx(v)) for (q, p), v in want.items() if q == 70)
    counts = calls.groupBy("chrom", "pos", "variant", "sample").agg(ld.F.when(ld.F.count_if(ld.F.col("dosage").isNull()) == 0, ld.F.sum("dosage")).alias("dosage"))
    got = {(r["pos1"], r["pos2"]): r["value"] for r in ld.region_pairs(counts, 1300, "cov", True).collect()}
    g = h.sum(axis=2)
    filled = np.where(np.isnan(g), (np.nansum(g, axis=1) / 1300)[:, None], g)
    assert all(v == pytest.approx(np.cov(filled[i // 10], filled[j // 10], bias=True)[0, 1], abs=1e-9) for (i, j), v in got.items()) and len(got) == 66


def test_tiles_fit_a_task():
    for n_variants, n in ((12, 2600), (4_000, 2_000_000), (100_000, 10_000), (1, 1), (0, 0), (5_000_000, 50_000_000)):
        blocks, parts = ld.tiles(n_variants, n)
        v, u = -(-n_variants // blocks), -(-n // parts)
        assert 8 * (2 * v * u + v * v) <= ld.TILE_BYTES and blocks >= 1 and parts >= 1
    assert ld.tiles(300, 3_000) == (1, 1)


def test_planned_tiles_give_the_pairs(cohort, monkeypatch):
    h, calls, _ = cohort
    monkeypatch.setattr(ld, "TILE_BYTES", 1 << 16)
    monkeypatch.setattr(ld.tiles, "__defaults__", (1 << 16,))
    assert ld.tiles(12, 2600)[1] > 1
    same(ld.dense_pairs(calls, 2600, "rsquare", diagonal=True), expected(h, "rsquare", True))


def test_dense_pages_are_those_of_the_join(cohort):
    from alleloom.plans import paging

    h, calls, _ = cohort
    for after in (None, paging.Cursor((0, 20, "1:20_A/C", 10**9, ""))):
        got = [[tuple(r) for r in paging.region_page(calls, 2600, "1", 0, 200, "rsquare", 40, 30, after, dense=dense).select("cell", "pos1", "pos2", ld.F.round("value", 9)).collect()] for dense in (False, True, None)]
        assert got[0] == got[1] == got[2] and len(got[0]) == 30
