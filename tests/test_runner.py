"""Requests about groups of variants, from genotypes and from precomputed statistics, against numpy and stated values."""

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from alleloom.errors import QueryError
from alleloom.operators import genotype, ld, score, sumstats
from alleloom.plans import paging, render, runner
from alleloom.sources import catalog, files

N, VARIANTS = 60, 14


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(8)
    g = rng.binomial(2, rng.uniform(0.05, 0.6, VARIANTS)[:, None], (VARIANTS, N)).astype(float)
    g[2] = 0
    g[2, 5] = 1  # only a sample without a phenotype carries it
    g[4, 7:10] = math.nan
    y = rng.normal(size=N)
    y[[5, 20]] = math.nan
    rows = [("1", 10 * i, f"1:{10 * i}_A/C", f"s{j}", None if math.isnan(v) else float(v)) for i, r in enumerate(g) for j, v in enumerate(r) if v != 0]
    calls = spark.createDataFrame(rows, "chrom string, pos long, variant string, sample string, dosage double").cache()
    samples = spark.createDataFrame([(f"s{j}",) for j in range(N)], "sample string")
    phenotype = spark.createDataFrame([(f"s{j}", float(v)) for j, v in enumerate(y)] + [("other", 1.0)], "sample string, y double")
    return g, y, calls, samples, phenotype


def genes(spark, **groups):
    rows = [(k, "1", 10 * i, f"1:{10 * i}_A/C") for k, v in groups.items() for i in v]
    return spark.createDataFrame(rows, "group string, chrom string, pos long, variant string")


def test_compute(spark, cohort):
    g, y, calls, samples, phenotype = cohort
    masks = runner.masked([("first", genes(spark, B=range(0, 6), A=[3, 8, 9], gone=[2])), ("second", genes(spark, A=[0, 1]))])
    a = runner.compute(calls, samples, phenotype, masks)
    have = ~np.isnan(y)
    n, sigma2 = int(have.sum()), y[have].var()
    assert a.nsamples == n and abs(a.sigma2 - sigma2) < 1e-12
    x = g[:, have]
    means = np.nansum(x, axis=1) / n
    filled = np.where(np.isnan(x), means[:, None], x)
    want = {(m, k, 10 * i, 10 * j): np.cov(filled[i], filled[j], bias=True)[0, 1] / sigma2 for m, k, v in (("first", "B", (0, 1, 3, 4, 5)), ("first", "A", (3, 8, 9)), ("second", "A", (0, 1))) for i in v for j in v if i <= j}
    got = {(r["mask"], r["group"], r["pos1"], r["pos2"]): r["value"] for r in a.pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    groups = {(r["mask"], r["group"]): (r["n_variants"], r["mean_minor_freq"]) for r in a.groups.collect()}
    af = means / 2
    assert groups.keys() == {("first", "A"), ("first", "B"), ("second", "A")}
    assert groups["second", "A"][0] == 2 and abs(groups["second", "A"][1] - np.minimum(af, 1 - af)[:2].mean()) < 1e-12
    variants = {r["pos"]: (r["first_group"], r["score_stat"]) for r in a.variants.collect()}
    assert {k: v[0] for k, v in variants.items()} == {0: "B", 10: "B", 30: "A", 40: "B", 50: "B", 80: "A", 90: "A"}
    u = {10 * i: ((np.where(np.isnan(x[i]), means[i], x[i])) * (y[have] - y[have].mean())).sum() / sigma2 for i in (0, 1, 3, 4)}
    assert all(abs(variants[k][1] - v) < 1e-9 for k, v in u.items())

    some = samples.where("sample < 's4'")
    b = runner.compute(calls, samples, phenotype, masks, [{"field": "pvalue", "op": "gte", "value": 0.3}], some)
    kept = {r["pos"] for r in b.variants.collect()}
    assert b.nsamples == sum(f"s{j}" < "s4" for j in np.flatnonzero(have)) and kept < set(variants)
    assert {r[c] for r in b.pairs.collect() for c in ("pos1", "pos2")} == kept
    with pytest.raises(QueryError):
        runner.compute(calls, samples.where("sample = 's5'"), phenotype, masks)
    with pytest.raises(QueryError):
        runner.masked([])

    body = render.aggregation(a, variant_format="COLONS", genotypeDataset=7, phenotype="y").collect()[0].asDict(recursive=True)
    first = body["groups"][0]
    assert [(x["mask"], x["group"]) for x in body["groups"]] == [("first", "A"), ("first", "B"), ("second", "A")]
    assert first["variants"] == ["1:30:A:C", "1:80:A:C", "1:90:A:C"] and len(first["covariance"]) == 6 and first["groupType"] == "GENE"
    assert [x["variant"] for x in body["variants"]][:2] == ["1:0:A:C", "1:10:A:C"] and body["nSamples"] == n and body["genotypeDataset"] == 7
    empty = render.empty_aggregation(spark, genotypeDataset=7)
    assert json.loads(render.as_json(empty).collect()[0]["json"])["data"] == {"variants": [], "groups": [], "sigmaSquared": None, "nSamples": None, "genotypeDataset": 7}


def test_precomputed_gives_what_is_computed(spark, cohort):
    g, y, calls, samples, phenotype = cohort
    own = phenotype.join(samples, "sample", "left_semi")
    m = score.moments(own).first()
    have = genotype.of_samples(calls, score.complete(own))
    masks = runner.masked([("one", genes(spark, A=range(0, 5), B=[6, 7, 8]))])
    a = runner.compute(calls, samples, phenotype, masks)
    scores = score.score_statistics(calls, own).withColumn("line", score.F.col("pos"))
    # the frequency over one half turns the sign in the file
    pairs = ld.region_pairs(have, m["nsamples"], "cov", True)
    af = scores.select("pos", "alt_freq")
    for i in ("1", "2"):
        pairs = pairs.join(af.select(score.F.col("pos").alias(f"pos{i}"), score.F.col("alt_freq").alias(f"f{i}")), f"pos{i}")
    F = score.F
    v = sumstats.oriented(F.col("value"), F.col("pos1") == F.col("pos2"), F.col("f1"), F.col("f2")) / m["sigma2"]
    cov = pairs.groupBy("chrom", F.col("pos1").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos2", v.alias("v")))).alias("r"))
    cov = cov.select("chrom", "pos", F.array_join(F.transform("r.pos2", lambda p: p.cast("string")), ",").alias("positions"), F.array_join(F.transform("r.v", lambda x: x.cast("string")), ",").alias("covs"))
    b = runner.precomputed(scores, cov, masks, sigma2=m["sigma2"], nsamples=m["nsamples"])
    key = lambda r: (r["group"], r["pos1"], r["pos2"])
    want, got = ({key(r): r["value"] for r in x.pairs.collect()} for x in (a, b))
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    p, q = ({r["pos"]: r["pvalue"] for r in x.variants.collect()} for x in (a, b))
    assert p.keys() == q.keys() and all(abs(q[k] - v) < 1e-9 for k, v in p.items())


def test_stated_score_statistics(spark):
    """Fixed values of a public file of score statistics: counts of genotypes, U, the root of V, the p-value, frequency."""
    n, sigma2 = 2504, 0.0818831
    rows = [(239, 2192, 73, -46.0087, 60.6293, 0.447941, 0.466853), (275, 2159, 70, -23.7344, 63.3116, 0.707748, 0.459065), (692, 1794, 18, -138.032, 80.3449, 0.0857972, 0.365415), (317, 2153, 34, -27.5407, 62.4178, 0.659046, 0.44349)]
    spread = np.random.default_rng(1).normal(size=n)
    y = (spread - spread.mean()) / spread.std() * math.sqrt(sigma2)
    calls = [("21", k, f"21:{k}_A/C", j, 1.0 if j < het else 2.0) for k, (_, het, alt, *_) in enumerate(rows) for j in range(het + alt)]
    got = score.score_statistics(spark.createDataFrame(calls, "chrom string, pos long, variant string, sample long, dosage double"), spark.createDataFrame([(j, float(v)) for j, v in enumerate(y)], "sample long, y double"))
    z = got.select("pos", "alt_freq", "score_stat", "pvalue").collect()
    for r in z:
        ref, het, alt, u, root, p, af = rows[r["pos"]]
        g = np.repeat([1.0, 2.0, 0.0], [het, alt, ref])
        v = math.sqrt(((g - g.mean()) ** 2).sum() / sigma2)
        assert abs(v - root) < 3e-5 * root and abs(r["alt_freq"] - af) < 1e-6
        assert abs(r["pvalue"] - math.erfc(abs(r["score_stat"] / v) / math.sqrt(2))) < 2e-6
    frame = spark.createDataFrame([(i, r[3] / r[4], r[5]) for i, r in enumerate(rows)], "i long, z double, p double")
    from alleloom.functions.variants import two_sided_p

    assert all(abs(r["q"] - r["p"]) < 2e-6 for r in frame.withColumn("q", two_sided_p(frame["z"])).collect())


BLOCK_META = ("chrom", "pos_start", "pos_end", "region_start", "region_mid", "region_end")


def write_block(path, table, meta, **more):
    pq.write_table(table.replace_schema_metadata(dict(zip(BLOCK_META, map(str, meta), strict=True)) | more), path)
    return str(path)


def block_files(tmp_path, cutoff=0.3):
    """Three blocks of four variants; a covariance block holds products with its own and the next block's variants."""
    rng = np.random.default_rng(2)
    n, k, positions = 50, 3, [5, 20, 31, 44, 52, 60, 77, 90, 101, 120, 130, 149]
    g = rng.binomial(2, 0.15, (12, n)).astype(float)
    g[5] = 2  # over the cutoff
    x, y = rng.normal(size=(n, k)), rng.normal(size=n)
    maf = g.mean(axis=1) / 2
    low = np.flatnonzero(maf < cutoff)
    block = np.arange(12) // 4
    gtu, gtg = g @ x, g @ g.T
    scores, covs = [], []
    for b in range(3):
        own = np.flatnonzero(block == b)
        t = {"chr": ["1"] * 4, "pos": [positions[i] for i in own], "ref": ["A"] * 4, "alt": ["C"] * 4, "alt_AC": [int(g[i].sum()) for i in own], "MAC": [int(g[i].sum()) for i in own], "MAF": maf[own], "N": [n] * 4, "U": g[own] @ y, "V": g[own].sum(axis=1) + 1}
        t |= {f"c{i}": gtu[own, i] for i in range(k)}
        region = ("1", positions[own[0]], positions[own[-1]], 50 * b, 50 * b + 49, 50 * b + 99)
        scores.append(write_block(tmp_path / f"s{b}.parquet", pa.table(t), region))
        places = [i for i in low if block[i] in (b, b + 1)]
        entries = [(r, c, gtg[i, j]) for r, i in enumerate(places) for c, j in enumerate(places) if r <= c and block[i] == b and gtg[i, j]]
        t = {name: pa.array(v, kind) for name, v, kind in zip(("row", "col", "GtG"), zip(*entries, strict=True), (pa.uint32(), pa.uint32(), pa.float64()), strict=True)}
        covs.append(write_block(tmp_path / f"v{b}.parquet", pa.table(t), region, cov_maf_cutoff=str(cutoff)))
    near = np.abs(block[:, None] - block[None, :]) <= 1
    value = (np.where(near, gtg, 0) - gtu @ gtu.T) / n
    return scores, covs, positions, low, value, g, y


def test_blocks_end_to_end(spark, tmp_path):
    scores, covs, positions, low, value, g, y = block_files(tmp_path)
    cat = catalog.Catalog(spark)
    cat.add_blocks({"id": "m"}, scores, covs)
    chosen = cat.blocks_of("m", "1", 25, 48)
    assert [r["block"] for r in chosen.orderBy("block").collect()] == [0, 1]  # the one it meets and the next
    with pytest.raises(QueryError):
        cat.blocks_of("m", "2", 25, 48)
    manifest = cat.blocks["m"]
    rows = files.read_blocks(spark, scores, manifest)
    gtg = files.read_block_covariances(spark, covs, manifest)
    variants = sumstats.cutoff_variants(rows)
    assert [(r["pos"], r["idx"]) for r in variants.orderBy("pos").collect()] == [(positions[i], k) for k, i in enumerate(low)]
    found, pairs = sumstats.load_blocks(variants, gtg, "1", 20, 140)
    inside = [i for i in low if 20 <= positions[i] <= 140]
    want = {(positions[i], positions[j]): value[i, j] for i in inside for j in inside if i <= j}
    got = {(r["pos1"], r["pos2"]): r["value"] for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    stats = {r["pos"]: (r["z"], r["alt_freq"]) for r in found.collect()}
    assert all(abs(stats[positions[i]][0] - g[i] @ y / math.sqrt(g[i].sum() + 1)) < 1e-9 and abs(stats[positions[i]][1] - g[i].sum() / 100) < 1e-12 for i in inside)
    groups = spark.createDataFrame([("G", "1", positions[i], f"1:{positions[i]}_A/C") for i in (0, 2, 5, 9)], "group string, chrom string, pos long, variant string")
    a = runner.precomputed_blocks(rows, gtg, runner.masked([("m", groups)]))
    got = {(r["pos1"], r["pos2"]): r["value"] for r in a.pairs.collect()}
    want = {(positions[i], positions[j]): value[i, j] for i in (0, 2, 9) for j in (0, 2, 9) if i <= j}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and a.sigma2 is None and a.nsamples == 50
    extra = write_block(tmp_path / "again.parquet", pq.read_table(covs[1]), ("1", 52, 90, 60, 80, 90), cov_maf_cutoff="0.3")
    with pytest.raises(Exception, match="needs one covariance block, and has 2"):
        sumstats.block_pairs(files.block_manifest(spark, scores), files.block_manifest(spark, [*covs, extra])).collect()


def test_variant_and_score_shapes(spark, cohort):
    _, _, calls, samples, phenotype = cohort
    rows = ld.variant(calls, N, "1:10_A/C", "1", 0, 100, "cov")
    flat = render.variant_classic(rows, 3).collect()[0]
    assert flat["position2"] == [10 * i for i in range(11)] and set(flat["variant1"]) == {"1:10_A/C"} and set(flat["position1"]) == {10}
    one = render.variant_compact(rows, 3).collect()[0]
    assert (one["index_variant"], one["index_chromosome"], one["index_position"]) == ("1:10_A/C", "1", 10) and one["correlations"] == flat["correlation"] and one["positions"] == flat["position2"]
    none = render.variant_compact(ld.variant(calls, N, "1:11_A/C", "1", 0, 100, "cov")).collect()[0]
    assert none["index_variant"] is None and none["variants"] == []
    stats = score.score_statistics(calls, phenotype.join(samples, "sample", "left_semi"))
    out = render.scores(stats, 0.5, 58).collect()[0]
    assert out["position"] == sorted(out["position"]) and len(out["alt_freq"]) == len(out["variant"]) == 13 and (out["sigma2"], out["nsamples"]) == (0.5, 58)
    nan = stats.limit(1).withColumn("score_stat", score.F.lit(math.nan))
    assert json.loads(render.as_json(render.scores(nan)).collect()[0]["json"])["data"]["score_stat"] == [None]
    got, after = [], None
    while True:
        part = paging.variant_page(calls, N, "1:10_A/C", "1", 0, 100, "cov", 30, 4, after).collect()
        got += [r["pos"] for r in part]
        after = paging.next_cursor(part, paging.VARIANT_ORDER, 4, after)
        if after is None:
            break
    assert sorted(got) == flat["position2"]
    with pytest.raises(Exception, match="a response holds 5 rows at most"):
        render._one_page(rows, score.F.struct("pos"), 5).collect()
    with pytest.raises(QueryError):
        paging.score_page(stats, 30, 4, paging.Cursor((1,)))


def test_stored_parts_read_each_file_once(spark, cohort, tmp_path):
    _, _, calls, samples, phenotype = cohort
    masks = runner.masked([("first", genes(spark, B=range(0, 6), A=[3, 8, 9])), ("second", genes(spark, A=[0, 1]))])
    plain, kept = runner.compute(calls, samples, phenotype, masks), runner.compute(calls, samples, phenotype, masks, root=str(tmp_path))
    for name in ("variants", "members", "pairs", "groups"):
        a, b = getattr(plain, name), getattr(kept, name)
        key = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(sorted(df.columns)).collect())
        assert key(a) == key(b) != []
        plan = b._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" not in plan and "LogicalRDD" not in plan and "Relation [" in plan
