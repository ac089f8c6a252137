"""Readers, phenotype coding, request checks, pages and response shapes on small files."""

import json
import math

import numpy as np
import pytest

from alleloom.errors import QueryError
from alleloom.functions import variants as V
from alleloom.operators import genotype, ld, phenotypes, sumstats
from alleloom.plans import cache, paging, render, requests, service
from alleloom.sources import catalog, files


def write(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join("\t".join(map(str, x)) if isinstance(x, tuple) else x for x in lines) + "\n")
    return str(path)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def score_line(n_columns, **at):
    row = ["NA"] * n_columns
    for k, v in at.items():
        row[int(k[1:])] = v
    return tuple(row)


def test_vcf(spark, tmp_path):
    path = write(
        tmp_path, "a.vcf", "##fileformat=VCFv4.2", ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "s1", "s2", "s3"),
        ("1", 10, ".", "A", "C,G", ".", ".", ".", "GT:DP", "0|1:3", "2/2:1", "./.:0"), ("1", 90, ".", "T", "TA", ".", ".", ".", "GT", "0|0", "1|1", "0|1"), ("2", 10, ".", "A", "C", ".", ".", ".", "GT", "1|0", "0|0", "0|0"),
    )
    assert values(files.vcf_samples(spark, path), "idx", "sample") == [(0, "s1"), (1, "s2"), (2, "s3")]
    assert set(values(files.vcf_variants(spark, path), "variant")) == {("1:10_A/C",), ("1:10_A/G",), ("1:90_T/TA",), ("2:10_A/C",)}
    want = {("1:10_A/C", "s1", 1), ("1:10_A/G", "s2", 2), ("1:10_A/C", "s3", None), ("1:10_A/G", "s3", None), ("1:90_T/TA", "s2", 2), ("1:90_T/TA", "s3", 1), ("2:10_A/C", "s1", 1)}
    assert set(values(files.open_genotypes(spark, path), "variant", "sample", "dosage")) == want
    assert {v for v, _, _ in values(files.read_vcf(spark, path, "1", 50, 90), "variant", "sample", "dosage")} == {"1:90_T/TA"}
    with pytest.raises(QueryError):
        files.open_genotypes(spark, "a.bcf")


HEAD = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def test_stored_calls_are_pruned_to_their_segments(spark, tmp_path):
    rows = [("1", 10, "1:10_A/C", "a", 1.0), ("1", 2_500_000, "1:2500000_A/C", "b", None), ("X", 10, "X:10_A/C", "a", 2.0)]
    files.write_calls(spark.createDataFrame(rows, "chrom string, pos long, variant string, sample string, dosage double"), str(tmp_path / "calls.parquet"))
    back = files.open_genotypes(spark, str(tmp_path / "calls.parquet"))
    assert set(values(back, "chrom", "pos", "variant", "sample", "dosage")) == set(rows)
    some = genotype.in_region(back, "1", 2_000_000, 2_999_999)
    assert values(some, "variant") == [("1:2500000_A/C",)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "segment#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert {r["chrom"] for r in genotype.chromosomes(back).collect()} == {"1", "X"}


def test_each_file_names_its_own_samples(spark, tmp_path):
    a = write(tmp_path, "a.vcf", (*HEAD, "s1", "s2"), ("1", 10, ".", "A", "C", ".", ".", ".", "GT", "0|1", "0|0"))
    b = write(tmp_path, "b.vcf", (*HEAD, "s2", "s1"), ("2", 10, ".", "A", "C", ".", ".", ".", "GT", "0|1", "0|0"))
    assert set(values(files.read_vcf(spark, [a, b]), "variant", "sample")) == {("1:10_A/C", "s1"), ("2:10_A/C", "s2")}
    assert {r["sample"] for r in files.same_samples(spark, [a, b]).collect()} == {"s1", "s2"}
    c = write(tmp_path, "c.vcf", (*HEAD, "s1", "s3"), ("3", 10, ".", "A", "C", ".", ".", ".", "GT", "0|1", "0|0"))
    with pytest.raises(QueryError):
        files.same_samples(spark, [a, c])
    cat = catalog.Catalog(spark)
    with pytest.raises(QueryError):
        cat.add_genotypes({"id": "bad", "files": [a, c]})
    cat.add_genotypes({"id": "g", "genome_build": "b37", "files": [a, b]})
    assert {r["chrom"] for r in cat.chromosomes("g").collect()} == {"1", "2"}
    assert values(cat.populations("g"), "subset", "n_samples") == [("ALL", 2)] and cat.samples("g").count() == 2 and cat.samples("g", "no").count() == 0
    assert values(cat.references("b37"), "id") == [("g",)] and cat.references("b38").count() == 0 and cat.files("genotypes", "g").count() == 2
    with pytest.raises(QueryError):
        cat.files("genotypes", "none")


def haplotype_file(tmp_path, n_samples=40, n_variants=12):
    rng = np.random.default_rng(4)
    h = (rng.random((n_variants, n_samples, 2)) < rng.uniform(0.1, 0.8, n_variants)[:, None, None]).astype(int)
    h[3] = 0
    h[5] = h[4]
    h[6, :, 0], h[6, :, 1] = 1, 0  # every sample carries it, on one haplotype
    lines = [("1", 10 * i, ".", "A", "C", ".", ".", ".", "GT", *[f"{x}|{y}" for x, y in v]) for i, v in enumerate(h)]
    return write(tmp_path, "h.vcf", (*HEAD, *[f"s{i}" for i in range(n_samples)]), *lines), h


def test_haplotype_correlations_against_numpy(spark, tmp_path):
    path, h = haplotype_file(tmp_path)
    calls = files.open_genotypes(spark, path, haplotypes=True)
    people = files.same_samples(spark, [path])
    n = genotype.size(people, haplotypes=True)
    flat = h.reshape(len(h), -1)
    want = {(10 * i, 10 * j): np.corrcoef(flat[i], flat[j])[0, 1] for i in range(len(h)) for j in range(i + 1, len(h)) if 3 not in (i, j)}
    for metric, power in (("r", 1), ("rsquare", 2), ("rsquare_approx", 2)):
        for dense in (False, True):
            got = {(a, b): v for a, b, v in values(ld.region(calls, n, "1", 0, 200, metric, dense=dense), "pos1", "pos2", "value")}
            assert got.keys() == want.keys() and all(abs(got[k] - v**power) < 1e-9 for k, v in want.items())
    counts = genotype.as_samples(calls)
    assert set(map(tuple, counts.select("variant", "sample", "dosage").collect())) == set(values(files.read_vcf(spark, path), "variant", "sample", "dosage"))
    dosage = h.sum(axis=2)
    cov = {(a, b): v for a, b, v in values(ld.region(counts, len(h[0]), "1", 0, 200, "cov", True, dense=None), "pos1", "pos2", "value")}
    assert all(abs(v - np.cov(dosage[a // 10], dosage[b // 10], bias=True)[0, 1]) < 1e-9 for (a, b), v in cov.items()) and len(cov) == 66
    one = {p: v for p, v in values(ld.variant(calls, n, "chr1:40:A:C", "1", 0, 200), "pos", "value")}
    assert abs(one[40] - 1) < 1e-12 and abs(one[50] - 1) < 1e-12 and len(one) == 11
    assert ld.variant(calls, n, "2:40:A:C", "1", 0, 200).count() == 0 and ld.variant(calls, n, "1:40:A:G", "1", 0, 200).count() == 0
    assert ld.region(calls, n, "7", 0, 200).count() == 0
    with pytest.raises(QueryError):
        ld.variant(calls, n, "rs123", "1", 0, 200)


def test_pages_form_their_own_cells_only(spark, tmp_path):
    path, h = haplotype_file(tmp_path)
    calls = files.open_genotypes(spark, path, haplotypes=True)
    whole = [tuple(r) for r in paging.celled(ld.region(calls, 80, "1", 0, 200), 30).orderBy(*paging.PAIR_ORDER).select("pos1", "pos2", "value").collect()]
    got, after = [], None
    while True:
        rows = paging.region_page(calls, 80, "1", 0, 200, "rsquare", 30, 7, after).collect()
        got += [(r["pos1"], r["pos2"], r["value"]) for r in rows]
        after = paging.next_cursor(rows, paging.PAIR_ORDER, 7, after)
        if after is None:
            break
        after = paging.Cursor.parse(str(after))
    assert [x[:2] for x in got] == [x[:2] for x in whole] and len(got) == 55
    assert paging.cells_of_page({0: 3, 1: 2, 5: 4}, 5) == [(0, 0), (0, 1)] and paging.cells_of_page({0: 3, 1: 2, 5: 4}, 5, after=paging.Cursor((2, 0))) == [(0, 1), (1, 1), (0, 5)]
    assert paging.cells_of_page({}, 5) == []
    for text in ("nonsense", "[]"):
        with pytest.raises(QueryError):
            paging.Cursor.parse(text)


def test_phenotype_table(spark, tmp_path):
    path = write(tmp_path, "p.tab", ("iid", "sex", "qt", "level", "bad"), ("a", "male", "0.5", "3", "x"), "# left out", ("b", "female", "NA", "1", "2"), "", ("c", "male", ".", "3", "y"), ("d", "NA", "7", "", "4.5"))
    rows = files.read_tab(spark, path)
    assert [r["iid"] for r in rows.orderBy("line").collect()] == ["a", "b", "c", "d"]
    assert dict(values(phenotypes.encode_by_appearance(rows, "sex", "line"), "level", "code")) == {"male": 0, "female": 1}
    assert dict(values(phenotypes.encode_by_appearance(rows, "level", "line"), "level", "code")) == {"3": 3, "1": 1}
    assert dict(values(phenotypes.encode_by_appearance(rows, "bad", "line"), "level", "code")) == {"x": 0, "2": 2, "y": 3, "4.5": 4}
    assert dict(values(phenotypes.infer_kinds(rows, ["sex", "qt", "level", "bad"], "line"), "column", "kind")) == {"sex": "TEXT", "qt": "FLOAT", "level": "INTEGER", "bad": "TEXT"}
    assert values(rows.select(phenotypes.number(rows["qt"]).alias("y")), "y") == [(0.5,), (None,), (None,), (7,)]
    with pytest.raises(Exception, match="not a number: x"):
        rows.select(phenotypes.number(rows["bad"])).collect()


def test_pedigree(spark, tmp_path):
    dat = write(tmp_path, "p.dat", "A disease", "M marker", "T height", "")
    ped = write(tmp_path, "p.ped", "f1 a 0 0 1 2 1/1 1.5", "f1 b 0 0 2 1 1/2 NA", "f2 c 0 0 2 -9 0/0 0.25", "f2 d 0 0 1 0 1/1 3")
    assert files.dat_columns(spark, dat) == [("disease", "CATEGORICAL"), ("marker", None), ("height", "FLOAT")]
    with pytest.raises(QueryError):
        files.dat_columns(spark, write(tmp_path, "bad.dat", "Z what"))
    rows = files.read_ped(spark, ped, dat)
    assert rows.columns == ["fid", "iid", "pid", "mid", "sex", "disease", "height", "line"]
    assert values(rows.orderBy("line").select(phenotypes.encode_pedigree(rows["disease"]).alias("d"), phenotypes.number(rows["height"]).alias("h")), "d", "h") == [(1, 1.5), (0, None), (None, 0.25), (None, 3)]
    with pytest.raises(Exception, match="not a status: 2.5"):
        spark.sql("select '2.5' s").select(phenotypes.encode_pedigree(V.F.col("s"))).collect()
    assert values(files.read_sample_list(spark, write(tmp_path, "s.txt", "a ", "", " b")), "sample") == [("a",), ("b",)]


def test_score_and_covariance_files(spark, tmp_path):
    rvtest = write(
        tmp_path, "r.score", "##ProgramName=Rvtests", "##AnalyzedSamples=50", "## - Sigma2\t1.25", tuple(["CHROM", "POS"] + ["X"] * 14),
        score_line(16, c0="1", c1=7, c2="A", c3="C", c4="50:20:30", c5="0.75:0.5:1", c6="75", c12="1.5", c13="3", c15="0.6"), score_line(16, c0="1", c1=9, c2="G", c3="T", c4="50", c5="NA", c6="10", c12="-2", c13="4", c15="0.6"),
    )
    assert values(files.header_scalars(spark, rvtest), "sigma2", "nsamples") == [(1.25, 50)]
    scores = files.read_scores(spark, rvtest)
    assert values(scores, "variant", "alt_freq", "n", "score_stat", "sqrt_v", "pvalue") == [("1:7_A/C", 0.75, 50, 1.5, 3, 0.6), ("1:9_G/T", 0.1, 50, -2, 4, 0.6)]
    cov = files.read_covariances(spark, write(tmp_path, "r.cov", "##ProgramName=Rvtests", ("CHROM", "START_POS", "END_POS", "NUM_MARKER", "MARKER_POS", "COV"), ("1", 7, 9, 2, "7,9", "0.5:1,0.25"), ("1", 9, 9, 1, "9", "2:1:1")))
    pairs = sumstats.load_region(cov, scores, "1", 7, 9)
    assert set(values(pairs, "variant1", "variant2", "value")) == {("1:7_A/C", "1:7_A/C", 0.5), ("1:7_A/C", "1:9_G/T", -0.25), ("1:9_G/T", "1:9_G/T", 2)}
    assert sumstats.unmatched_positions(cov, scores.where("pos = 7")).collect()[0]["pos"] == 9
    meta = write(tmp_path, "m.score", "##ProgramName=RareMetalWorker", "##Sigma_e2_Hat\t0.5", "#CHROM\tPOS", score_line(17, c0="1", c1=7, c2="A", c3="C", c4="44", c5="0.25", c6="0.75", c7="22", c13="oops", c14="3", c16="0.6"))
    assert values(files.header_scalars(spark, meta), "sigma2", "nsamples") == [(0.5, 44)]
    with pytest.raises(Exception, match="U_STAT is no number at 1:7"):
        files.read_scores(spark, meta).collect()
    assert files.sniff_format(spark, write(tmp_path, "bare.txt", *["## more"] * 300, "#CHROM\tPOS\tREF\tALT\tN_INFORMATIVE\tFOUNDER_AF\tALL_AF")) == "RAREMETAL"
    assert files.sniff_format(spark, write(tmp_path, "rv.txt", "CHROM\tPOS\tREF\tALT\tN_INFORMATIVE\tAF")) == "RVTEST"
    for lines in (["nothing known"], ["##ProgramName=Other", "CHROM\tPOS\tREF\tALT\tN_INFORMATIVE\tAF"]):
        with pytest.raises(QueryError):
            files.sniff_format(spark, write(tmp_path, "odd.txt", *lines))


def test_masks(spark, tmp_path):
    path = write(tmp_path, "m.tab", ("G1", "1", 5, 9, "1:5_A/C", "1:9_G/T"), ("G2", "1", 50, 60, "1:50_A/C"), ("G3", "2", 5, 9, "2:5_A/C"))
    assert values(files.read_mask(spark, path).orderBy("variant"), "group", "pos") == [("G2", 50), ("G1", 5), ("G1", 9), ("G3", 5)]
    assert {r["group"] for r in files.read_mask(spark, path, "1", 9, 49).collect()} == {"G1"}
    assert set(values(files.mask_of(spark, {"G": ["1:9_G/T", "1:5_A/C"]}), "start", "stop", "pos")) == {(5, 9, 5), (5, 9, 9)}


def test_blocks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    names = ("chr", "pos", "ref", "alt", "alt_AC", "MAC", "MAF", "N", "U", "V", "c1", "c2")
    table = pa.table({k: [v] for k, v in zip(names, ("1", 5, "A", "C", 2, 2, 0.1, 10, 1.5, 3.0, 0.5, 0.25), strict=True)})
    meta = {"chrom": "1", "pos_start": "5", "pos_end": "5", "region_start": "1", "region_mid": "50", "region_end": "99"}
    pq.write_table(table.replace_schema_metadata(meta), tmp_path / "good.parquet")
    pq.write_table(table, tmp_path / "bare.parquet")
    found = files.block_manifest(spark, [str(tmp_path / "good.parquet")])
    assert sumstats.files_overlapping(found, "1", 50, 60).count() == 1 and sumstats.files_overlapping(found, "2", 50, 60).count() == 0
    assert values(files.read_blocks(spark, [str(tmp_path / "good.parquet")]), "chrom", "pos", "gtu") == [("1", 5, [0.5, 0.25])]
    assert values(found, "nrows", "ncols", "cutoff") == [(1, 12, None)]
    with pytest.raises(QueryError) as e:
        files.block_manifest(spark, [str(tmp_path / "bare.parquet")])
    assert "bare" in e.value.secret and "bare" not in str(e.value)


def test_catalog(spark, tmp_path):
    path = write(tmp_path, "c.yaml", "genotypes:", "- {id: 1, name: g, genome_build: GRCh37, filepath: g.vcf}", "phenotypes:", "- {id: 1, name: p, genotypes: [1], filepath: p.tab}")
    c = catalog.Catalog(spark)
    c.load_yaml(path)
    assert set(values(c.frame(), "kind", "id", "name")) == {("genotypes", "1", "g"), ("phenotypes", "1", "p")} and values(c.genome_builds(), "genome_build") == [("GRCh37",)]
    c.add_samples("1", "EUR", ["a", "b"])
    c.add_samples("1", "EUR", ["b", "c"])
    assert values(c.populations("1"), "subset", "n_samples") == [("EUR", 3)]
    c.add_samples("1", "EUR", ["z"], replace=True)
    assert values(c.samples("1", "EUR"), "sample") == [("z",)]
    for kind, entry in (("genotypes", {"id": 1}), ("masks", {"id": 5, "genotypes": [9]}), ("other", {"id": 1})):
        with pytest.raises(QueryError):
            c.add(kind, entry)
    text = tmp_path / "c.json"
    text.write_text(json.dumps([{"Name": "n", "Description": "d", "Genome build": "b", "Files": ["x", "y"], "Samples": {"ALL": ["s"]}}]))
    assert values(catalog.read_json_catalog(spark, str(text)), "name", "file", "subset", "samples") == [("n", "x", "ALL", ["s"]), ("n", "y", "ALL", ["s"])]


def test_z_order(spark):
    cells = [(0, 0), (0, 7), (7, 0), (7, 7)]
    df = spark.createDataFrame(cells, "i long, j long").withColumn("code", V.morton(V.F.col("i"), V.F.col("j")))
    assert [r["code"] for r in df.collect()] == [0, 42, 21, 63]
    assert values(df.select(*[x.alias(n) for x, n in zip(V.unmorton(V.F.col("code")), "ij", strict=True)]), "i", "j") == cells
    assert (paging.bigmin(58, 27, 102), paging.bigmin(19, 12, 45)) == (74, 36)


def test_pages_join_to_the_whole(spark):
    rows = [("1", i, f"1:{i}_A/C", j, f"1:{j}_A/C", i * j / 100) for i in range(0, 30, 3) for j in range(i + 3, 30, 3)]
    pairs = spark.createDataFrame(rows, "chrom string, pos1 long, variant1 string, pos2 long, variant2 string, value double")
    whole = [(r["pos1"], r["pos2"]) for r in paging.celled(pairs, 10).orderBy(*paging.PAIR_ORDER).collect()]
    got, after = [], None
    while True:
        part = paging.page(pairs, 10, 16, after).collect()
        got += [(r["pos1"], r["pos2"]) for r in part]
        after = paging.next_cursor(part, paging.PAIR_ORDER, 16, after)
        if after is None:
            break
        after = paging.Cursor.parse(str(after))
    assert got == whole and len(got) == 45


def test_response_shapes(spark):
    rows = [("1", 1, "a", 2, "b", 0.12345), ("1", 1, "a", 3, "c", math.nan), ("1", 2, "b", 3, "c", 0.5)]
    pairs = spark.createDataFrame(rows, "chrom string, pos1 long, variant1 string, pos2 long, variant2 string, value double")
    r = render.compact(pairs, 2).collect()[0]
    assert (r["variants"], r["positions"], r["offsets"], r["correlations"]) == (["a", "b", "c"], [1, 2, 3], [1, 2, -2147483648], [[0.12, None], [0.5], []])
    body = json.loads(render.as_json(render.classic(pairs, 2)).collect()[0]["json"])
    assert body["data"]["correlation"] == [0.12, None, 0.5] and body["data"]["position2"] == [2, 3, 3] and body["next"] is None and body["error"] is None


def test_requests():
    assert requests.region_request("1", 0, 10, "rsquare", 10**9)["limit"] == requests.PAGE_LIMIT
    for bad in ({"stop": 5}, {"stop": 10**8}, {"correlation": "what"}, {"limit": 0}, {"surplus": 1}):
        with pytest.raises(QueryError):
            requests.region_request(**({"chrom": "1", "start": 5, "stop": 9, "correlation": "r"} | bad))
    ask = {"chrom": "1", "start": 5, "stop": 9}
    assert requests.variant_request("chr1:7:A:C", correlation="r", **ask)["variant"] == "1:7_A/C"
    assert requests.listing_request(genotype="g", **ask) == ask | {"kind": "genotype", "dataset": "g"}
    for f, bad in ((requests.variant_request, {"variant": "rs1", "correlation": "r"}), (requests.listing_request, {}), (requests.listing_request, {"genotype": "g", "summary": "s"}), (requests.listing_request, {"genotype": "g", "surplus": 1})):
        with pytest.raises(QueryError):
            f(**(ask | bad))
    requests.aggregation_request(masks=[1], summary="s", filters=[{"field": "maf", "op": "lte", "value": 0.1}], groups=[(1, 9)])
    for bad in ({"masks": None}, {"genotype": "g", "phenotype": "p"}, {"filters": [{"field": "maf", "op": "eq", "value": 1}]}, {"groups": [(0, 10**7)]}):
        with pytest.raises(QueryError):
            requests.aggregation_request(**({"masks": [1], "summary": "s"} | bad))


def test_requests_of_a_genotype_dataset(spark, tmp_path):
    path, h = haplotype_file(tmp_path)
    g = service.Genotypes.open(spark, [path])
    assert g.n_samples == 40 and values(g.chromosomes(), "chrom") == [("1",)]
    some = [f"s{i}" for i in range(0, 40, 3)]
    own = g.of(spark.createDataFrame([(s,) for s in [*some, "unknown"]], "sample string"))
    assert own.n_samples == len(some)
    flat = h[:, ::3].reshape(len(h), -1)
    varied = [i for i in range(len(h)) if flat[i].any()]
    rows = own.region_ld("1", 0, 200, "r").collect()
    assert {(r["pos1"], r["pos2"]) for r in rows} == {(10 * i, 10 * j) for i in varied for j in varied if i < j}
    assert all(abs(r["value"] - np.corrcoef(flat[r["pos1"] // 10], flat[r["pos2"] // 10])[0, 1]) < 1e-9 for r in rows if r["value"] is not None)
    dosage = h[:, ::3].sum(axis=2)
    one = own.variant_ld("1:40:A:C", "1", 0, 200, "cov").collect()
    assert all(abs(r["value"] - np.cov(dosage[4], dosage[r["pos"] // 10], bias=True)[0, 1]) < 1e-9 for r in one) and len(one) == len(varied)
    y = spark.createDataFrame([(s, float(i * i % 7)) for i, s in enumerate(some[:-2])], "sample string, y double")
    assert own.scores(y, "1", 0, 200).count() == len([i for i in varied if dosage[i][:-2].any()])
    af = {r["pos"]: r["af"] for r in own.frequencies("1", 0, 200).collect()}
    assert all(abs(v - dosage[p // 10].mean() / 2) < 1e-12 for p, v in af.items())
    listing = [spark.createDataFrame([("1", 10 * i, f"1:{10 * i}_A/C") for i in part], "chrom string, pos long, variant string") for part in ([0, 1, 4], [1, 2, 5])]
    assert {(r["pos1"], r["pos2"]) for r in g.pairs(*listing, "rsquare").collect()} == {(0, 10), (0, 20), (0, 50), (10, 10), (10, 20), (10, 40), (10, 50), (20, 40), (40, 50)}
    assert g.region_ld("2", 0, 200, "r").count() == 0 and g.of(listing[0].select(V.F.lit("none").alias("sample"))).region_ld("1", 0, 200, "r").count() == 0
    with pytest.raises(QueryError):
        g.region_ld("1", 5, 5, "r")


def test_kept_results(spark, tmp_path):
    rows = [("1", i, f"1:{i}_A/C", j, f"1:{j}_A/C", i * j / 100) for i in range(6) for j in range(i + 1, 6)]
    made = []

    def compute():
        made.append(1)
        return spark.createDataFrame(rows, "chrom string, pos1 long, variant1 string, pos2 long, variant2 string, value double")

    asked = {"dataset": "d/1", "subset": "ALL", "metric": "r", "chrom": "1", "start": 0, "stop": 5}
    for _ in range(2):
        got = cache.kept_cells(spark, str(tmp_path / "kept"), 2, compute, **asked)
        assert {tuple(r)[:-1] for r in got.collect()} == set(rows)
    assert len(made) == 1 and {r["cell"] for r in got.where("pos1 = 4").collect()} == {12}
    cache.kept_cells(spark, str(tmp_path / "kept"), 2, compute, **(asked | {"subset": "EUR"}))
    assert len(made) == 2
    names = [cache.key(cache.SCORES, dataset="d", subset=s, chrom="1", start=1, stop=2, phenotypes="p", phenotype="y") for s in ("a/b", "a_b", "a%b")]
    assert len(set(names)) == 3 and all(n.count("/") == 6 for n in names)
    with pytest.raises(ValueError):
        cache.key(cache.CELLS, dataset="d")
