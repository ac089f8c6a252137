"""Binary variant files give the calls of the text that they were written from."""

import random

import pytest
from genotype_files import typed, write_bcf, write_bgzf
from test_indexed import Counting, vcf

from alleloom.errors import QueryError
from alleloom.sources import bcf, bgzf, files, indexed


def calls(df):
    return sorted(map(tuple, df.select("chrom", "pos", "variant", "sample", df["dosage"].cast("string")).collect()), key=str)


def mixed(n=120):
    """Records with haploid, partly missing, unphased and many alleles, long alleles and sites without an alternative."""
    r = random.Random(8)
    lines = vcf(n, 5).splitlines()
    out = []
    for line in lines:
        f = line.split("\t")
        if line[0] != "#":
            f[4] = r.choice([f[4], f[4], ",".join(["C", "G", "T", "AC" * 20]), "."])
            f[2] = r.choice([".", "rs1"])
            f[7] = "."
            most = 0 if f[4] == "." else len(f[4].split(","))
            f[9:] = [r.choice([f"{r.randint(0, most)}|{r.randint(0, most)}", f"{r.randint(0, most)}/.", str(r.randint(0, most)), "./.", "0/0"]) for _ in f[9:]]
        out.append("\t".join(f))
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("size,wide", [(100, False), (5_000, True)])
def test_records_are_those_of_the_text(tmp_path, size, wide):
    text = mixed()
    path = tmp_path / "a.bcf"
    write_bcf(path, text, size, wide)
    with open(path, "rb") as file:
        header = bcf.Header.read(file)
        got = [line.split("\t") for _, _, line in bcf.lines(file, header, header.first)]
    want = [x.split("\t") for x in text.splitlines() if x[0] != "#"]
    assert [x[:5] + x[9:] for x in got] == [x[:5] + x[9:] for x in want]
    assert header.lines[-1] == next(x for x in text.splitlines() if x.startswith("#CHROM")) and header.names[9] == "DP"


def test_calls_are_those_of_the_text(spark, tmp_path):
    text = vcf(300, 5)
    (tmp_path / "a.vcf").write_text(text)
    write_bcf(tmp_path / "a.bcf", text, 2_000)
    plain, binary = str(tmp_path / "a.vcf"), str(tmp_path / "a.bcf")
    for haplotypes in (False, True):
        assert calls(files.open_genotypes(spark, binary, haplotypes)) == calls(files.open_genotypes(spark, plain, haplotypes)) != []
    assert [r["sample"] for r in files.vcf_samples(spark, binary).collect()] == [f"s{k}" for k in range(5)]
    for region in (("2", 20_000, 60_000), ("X", 0, 10**9), ("7", 0, 10), ("1", 1, 1)):
        assert calls(files.read_vcf(spark, binary, *region)) == calls(files.read_vcf(spark, plain, *region))
    rows = indexed.read_lines(spark, [binary], split=2_000)
    assert rows.rdd.getNumPartitions() > 2 and rows.count() == 900


def test_a_region_reads_its_blocks_only(tmp_path):
    text = vcf(20_000, 4)
    path = str(tmp_path / "a.bcf")
    write_bcf(path, text, 20_000)
    reader = indexed.LinesReader({"paths": path, "chrom": "2", "start": "5000000", "stop": "5050000"})
    parts, file = reader.partitions(), Counting(path)
    got = [x.split(b"\t")[:2] for p in parts for x in reader._lines(file, p)]
    want = [x.split("\t")[:2] for x in text.splitlines() if x.startswith("2\t") and 5_000_000 <= int(x.split("\t")[1]) <= 5_050_000]
    assert [[a.decode(), b.decode()] for a, b in got] == want and len(want) > 50
    assert file.taken <= 3 * bgzf.BLOCK < len(file.getvalue()) / 2, file.taken


def test_broken_files_are_errors(spark, tmp_path):
    write_bgzf(tmp_path / "a.bcf", b"VCF\x02\x02" + b"\0" * 50)
    with pytest.raises(QueryError):
        bcf.Header.read(open(tmp_path / "a.bcf", "rb"))
    text = vcf(3, 2)
    write_bcf(tmp_path / "b.bcf", text, 10**6)
    with open(tmp_path / "b.bcf", "rb") as f:
        whole = b"".join(x for _, _, x in bgzf.blocks(f, 0))
    write_bgzf(tmp_path / "c.bcf", whole[:-7], 10**6 // 20)
    with open(tmp_path / "c.bcf", "rb") as f, pytest.raises(QueryError):
        header = bcf.Header.read(f)
        list(bcf.lines(f, header, header.first))
    (tmp_path / "d.bcf").write_bytes(b"plain")
    for name in ("d.bcf", "none.bcf"):
        with pytest.raises(QueryError):
            files.open_genotypes(spark, str(tmp_path / name))
    assert bcf.typed(typed("x" * 40, "s"), 0) == ("x" * 40, 44) and bcf.typed(b"\x00", 0)[1] == 1
    with pytest.raises(QueryError):
        bcf.typed(b"\x14\x00", 0)
