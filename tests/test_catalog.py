"""Catalogs register what they list, or nothing."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from genotype_files import write_bcf
from test_indexed import vcf

from alleloom.errors import QueryError
from alleloom.sources.catalog import Catalog


def block(path, a, b, score=True):
    names = ("chr", "pos", "ref", "alt", "alt_AC", "MAC", "MAF", "N", "U", "V", "c1") if score else ("row", "col", "GtG")
    row = ("1", a, "A", "C", 2, 2, 0.1, 10, 1.5, 3.0, 0.5) if score else (0, 0, 1.0)
    meta = {"chrom": "1", "pos_start": str(a), "pos_end": str(b), "region_start": str(a), "region_mid": str(b), "region_end": str(b), "cov_maf_cutoff": "0.05"}
    pq.write_table(pa.table({k: [v] for k, v in zip(names, row, strict=True)}).replace_schema_metadata(meta), path)


@pytest.fixture
def folder(tmp_path):
    text = vcf(20, 3)
    (tmp_path / "a.vcf").write_text(text)
    write_bcf(tmp_path / "b.bcf", text, 5000)
    (tmp_path / "p.tab").write_text("iid\tsex\tbmi\n" + "".join(f"s{k}\tM\t{k}.5\n" for k in range(3)))
    (tmp_path / "names.txt").write_text("s0\ns1\n")
    (tmp_path / "m.tab").write_text("g\t1\t1\t9\t1:5_A/C\n")
    (tmp_path / "x.assoc").write_text("##ProgramName=RareMetalWorker\n#CHROM\n1\t2\n")
    for k, (a, b) in enumerate(((1, 50), (51, 100))):
        block(tmp_path / f"s{k}.parquet", a, b)
        block(tmp_path / f"c{k}.parquet", a, b, False)
    return tmp_path


def entries(folder):
    return {
        "genotypes": [{"id": 1, "name": "g", "description": "d", "genome_build": "GRCh37", "filepath": f"{folder}/*.vcf"}, {"id": 2, "name": "b", "filepath": f"{folder}/b.bcf", "samples": f"{folder}/names.txt"}],
        "phenotypes": [{"id": 1, "name": "p", "genotypes": [1, 2], "filepath": f"{folder}/p.tab", "columns": {"sex": {"type": "CATEGORICAL"}}}],
        "summary_stats": [{"id": 1, "name": "x", "score_path": f"{folder}/x.assoc", "cov_path": f"{folder}/x.assoc"}, {"id": 2, "name": "blocks", "format": "METASTAAR", "score_path": f"{folder}/s*.parquet", "cov_path": f"{folder}/c?.parquet"}],
        "masks": [{"id": 1, "name": "m", "genotypes": [1], "summary_stats": [1, 2], "group_type": "GENE", "identifier_type": "ENSEMBL", "filepath": f"{folder}/m.tab"}],
    }


def saved(folder, listed):
    (folder / "c.yaml").write_text(json.dumps(listed))  # JSON is YAML
    return str(folder / "c.yaml")


def test_a_catalog_registers_samples_kinds_and_blocks(spark, folder):
    c = Catalog(spark)
    c.register_yaml(saved(folder, entries(folder)))
    assert {r["sample"] for r in c.samples("1").collect()} == {"s0", "s1", "s2"} and {r["sample"] for r in c.samples("2").collect()} == {"s0", "s1"}
    assert c.datasets["phenotypes", "1"]["kinds"] == {"sex": "CATEGORICAL", "bmi": "FLOAT"}
    assert c.datasets["summary_stats", "1"]["format"] == "RAREMETAL"
    assert [r["block"] for r in c.blocks_of("2", "1", 60, 70).collect()] == [1]
    assert {r["chrom"] for r in c.chromosomes("2").collect()} == {"1", "2", "X"}
    assert {tuple(r) for r in c.links().collect()} == {("phenotypes", "1", "genotypes", "1"), ("phenotypes", "1", "genotypes", "2"), ("masks", "1", "genotypes", "1"), ("masks", "1", "summary_stats", "1"), ("masks", "1", "summary_stats", "2")}
    assert [(r["kind"], r["id"]) for r in c.linked("masks", "summary_stats", "2").collect()] == [("masks", "1")] and c.linked("masks", "genotypes", "2").count() == 0
    with pytest.raises(QueryError):  # ids are taken now
        c.register_yaml(saved(folder, entries(folder)))


@pytest.mark.parametrize(
    "where,change",
    [
        ("genotypes", {"filepath": "{0}/none*.vcf"}), ("genotypes", {"samples": []}), ("genotypes", {"id": 2}), ("phenotypes", {"columns": {"sex": {"type": "COLOUR"}}}), ("phenotypes", {"columns": {"age": {}}}), ("phenotypes", {"genotypes": [7]}),
        ("phenotypes", {"filepath": "{0}/m.tab"}), ("summary_stats", {"format": "OTHER"}), ("summary_stats", {"cov_path": "{0}/none"}), ("masks", {"group_type": "TOWN"}), ("masks", {"identifier_type": None}), ("masks", {"summary_stats": [9]}), ("extra", None),
    ],
)
def test_a_wrong_catalog_registers_nothing(spark, folder, where, change):
    listed = entries(folder)
    if change is None:
        listed[where] = []
    else:
        listed[where][0] |= {k: v.format(folder) if isinstance(v, str) else v for k, v in change.items()}
    c = Catalog(spark)
    with pytest.raises(QueryError):
        c.register_yaml(saved(folder, listed))
    assert not c.datasets and not c.subsets and not c.blocks


def test_json_references_are_registered_with_their_subsets(spark, folder):
    (folder / "r.json").write_text(json.dumps([{"Name": "n", "Description": "d", "Genome build": "b", "Files": [f"{folder}/a.vcf", f"{folder}/b.bcf"], "Samples": {"ALL": ["s0", "s1", "s2"], "EUR": ["s1"]}}]))
    c = Catalog(spark)
    c.register_json(str(folder / "r.json"))
    assert {(r["subset"], r["n_samples"]) for r in c.populations("n").collect()} == {("ALL", 3), ("EUR", 1)}
    assert [r["genome_build"] for r in c.genome_builds().collect()] == ["b"] and len(c.datasets["genotypes", "n"]["paths"]) == 2
    (folder / "bad.json").write_text(json.dumps([{"Name": "m", "Files": [f"{folder}/gone.vcf"], "Samples": {}}]))
    with pytest.raises(QueryError):
        c.register_json(str(folder / "bad.json"))
    assert len(c.datasets) == 1
