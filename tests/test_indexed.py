"""Block-gzipped files: parts, chunks of an index, and how much of a file is read."""

import io
import random

import pytest
from genotype_files import write_bgzf, write_vcf_gz

from alleloom.errors import QueryError
from alleloom.sources import bgzf, files, indexed


class Counting(io.BytesIO):
    """Remembers what was read of a file."""

    def __init__(self, path):
        super().__init__(open(path, "rb").read())
        self.taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def vcf(n=400, samples=6, seed=1, step=900):
    r = random.Random(seed)
    out = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"s{k}" for k in range(samples)]])]
    for chrom in ("1", "2", "X"):
        pos = 0
        for _ in range(n):
            pos += r.randrange(0, step)
            out.append("\t".join([chrom, str(pos + 1), ".", "A", r.choice(["C", "G", "C,T"]), ".", ".", "." * r.randrange(1, 40), "GT", *[r.choice(["0|0", "0|1", "1|1", "1|0", ".|."]) for _ in range(samples)]]))
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("size", [40, 300, 5000, 65000])
def test_parts_of_a_file_have_each_line_once(tmp_path, size):
    for text in (vcf(60), vcf(60)[:-1], "", "\n\n\nab\n", "x" * 1000 + "\n" + "y\n" * 200):
        write_bgzf(tmp_path / "a.gz", text.encode(), size)
        data = (tmp_path / "a.gz").read_bytes()
        want = text.split("\n") if text and not text.endswith("\n") else text.split("\n")[:-1]
        for split in (50, 333, 4000, len(data) + 1):
            got = [x.decode() for at in range(0, len(data), split) for x in bgzf.part(io.BytesIO(data), at, at + split)]
            assert got == want, (size, split)
        assert [x.decode() for _, x in bgzf.lines(io.BytesIO(data), 0)] == want


@pytest.mark.parametrize("size,step", [(200, 900), (3000, 90_000), (60_000, 900)])
def test_chunks_of_a_region_hold_its_records(tmp_path, size, step):
    text = vcf(step=step)
    write_vcf_gz(tmp_path / "a.vcf.gz", text, size)
    index = bgzf.Tabix.read(open(tmp_path / "a.vcf.gz.tbi", "rb"))
    records = [x.split("\t")[:2] for x in text.splitlines() if x[0] != "#"]
    r = random.Random(size)
    for _ in range(40):
        chrom, start = r.choice(["1", "2", "X"]), r.randrange(0, 400 * step // 2)
        stop = start + r.choice([0, 100, step * 20, 400 * step])
        with Counting(tmp_path / "a.vcf.gz") as file:
            got = [x.decode().split("\t")[:2] for a, b in index.chunks(chrom, start, stop) for _, x in bgzf.lines(file, a, b)]
        inside = [x for x in got if x[0] == chrom and start <= int(x[1]) <= stop]
        assert inside == [x for x in records if x[0] == chrom and start <= int(x[1]) <= stop]
    assert index.chunks("7", 0, 10**9) == [] and index.chunks("1", 5, 4) == []


def test_a_region_reads_its_blocks_only(spark, tmp_path, monkeypatch):
    text = vcf(20_000, 4)
    path = str(tmp_path / "a.vcf.gz")
    write_vcf_gz(path, text, 20_000)
    reader = indexed.LinesReader({"paths": path, "chrom": "2", "start": "1000000", "stop": "1050000"})
    parts = reader.partitions()
    file = Counting(path)
    found = [x for p in parts for x in reader._lines(file, p)]
    want = [x for x in text.splitlines() if x.startswith("2\t") and 1_000_000 <= int(x.split("\t")[1]) <= 1_050_000]
    assert [x.decode() for x in found] == want and len(want) > 50
    assert file.taken <= 2 * bgzf.BLOCK < len(file.getvalue()) / 4, (file.taken, len(file.getvalue()))
    whole = files.read_vcf(spark, path, "2", 1_000_000, 1_050_000)
    plain = tmp_path / "a.vcf"
    plain.write_text(text)
    key = lambda df: sorted(map(tuple, df.select("variant", "sample", df["dosage"].cast("string")).collect()), key=str)
    assert key(whole) == key(files.read_vcf(spark, str(plain), "2", 1_000_000, 1_050_000)) != []
    head = indexed.LinesReader({"paths": path, "header": "true"})
    file = Counting(path)
    assert [x.decode() for x in head._lines(file, head.partitions()[0])] == text.splitlines()[:2] and file.taken <= 2 * bgzf.BLOCK


def test_a_long_chunk_and_a_whole_file_are_many_tasks(spark, tmp_path):
    text = vcf(6_000, 4)
    path = str(tmp_path / "a.vcf.gz")
    write_vcf_gz(path, text, 4_000)
    lines = [x for x in text.splitlines() if x[0] != "#"]
    rows = indexed.read_lines(spark, [path], split=20_000)
    assert rows.rdd.getNumPartitions() > 5
    assert [r["value"] for r in rows.collect()] == text.splitlines()
    region = indexed.read_lines(spark, [path], "1", 0, 10**9, split=20_000)
    assert region.rdd.getNumPartitions() > 2 and [r["value"] for r in region.collect()] == [x for x in lines if x.startswith("1\t")]
    bare = str(tmp_path / "b.vcf.gz")
    write_bgzf(bare, text.encode(), 4_000)  # no index: read whole, the region is then filtered
    assert files.vcf_variants(spark, bare, "X", 0, 100_000).count() == files.vcf_variants(spark, path, "X", 0, 100_000).count() > 0
    assert files.vcf_samples(spark, [path, bare]).count() == 8


def test_other_files_are_not_taken_for_blocks(spark, tmp_path):
    import gzip

    path = str(tmp_path / "plain.vcf.gz")
    with gzip.open(path, "wt") as f:
        f.write(vcf(20))
    assert not indexed.block_gzipped(path) and not indexed.block_gzipped("none.gz") and not indexed.block_gzipped("a.vcf")
    assert files.vcf_variants(spark, path).count() >= 60
    with pytest.raises(QueryError):
        bgzf.Tabix.parse(b"CSI\x01" + b"\0" * 40)
    write_bgzf(tmp_path / "d.gz", b"some lines\n" * 50, 200)
    damaged = bytearray((tmp_path / "d.gz").read_bytes())
    damaged[20] ^= 255
    with pytest.raises(Exception):
        list(bgzf.lines(io.BytesIO(bytes(damaged)), 0))
    with pytest.raises(QueryError):
        list(bgzf.lines(io.BytesIO(b"not a block at all"), 0))


def test_headers_and_footers_are_read_without_the_rest(spark, tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from alleloom.sources import stores

    path = tmp_path / "big.parquet"
    meta = {"chrom": "1", "pos_start": "5", "pos_end": "5", "region_start": "1", "region_mid": "50", "region_end": "99"}
    pq.write_table(pa.table({f"c{k}": np.random.default_rng(k).random(200_000) for k in range(4)}).replace_schema_metadata(meta), path)
    file = Counting(path)
    row = files.footer(str(path), file)
    assert row["nrows"] == 200_000 and row["ncols"] == 4 and row["region_mid"] == 50
    assert file.taken < 200_000 < path.stat().st_size / 10
    found = files.block_manifest(spark, [str(path)]).collect()
    assert [(r["nrows"], r["chrom"]) for r in found] == [(200_000, "1")]
    monkeypatch.setattr(files, "exists", lambda p: False)
    assert [(r["nrows"], r["chrom"]) for r in files.block_manifest(spark, [str(path)]).collect()] == [(200_000, "1")]
    text = tmp_path / "s.assoc"
    text.write_text("##ProgramName=Rvtests\nCHROM\tPOS\n1\t2\n" + "x\n" * 100_000)
    last = lambda x: x[:1] not in ("#", "C")
    assert stores.first_lines(str(text), last) == ["##ProgramName=Rvtests", "CHROM\tPOS", "1\t2"]
    assert stores.first_lines("none/such", last) is None and files.sniff_format(spark, str(text)) == "RVTEST"


def test_lines_keep_the_order_of_files_and_places(spark, tmp_path):
    import random as rnd

    for name, n in (("a.tab", 5), ("b.tab", 30_000)):  # the second is split, and its parts are larger
        (tmp_path / name).write_text("id\tv\n" + "".join(f"{name}{k:06d}\t{rnd.randrange(9)}\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = files.read_tab(spark, [str(tmp_path / "b.tab"), str(tmp_path / "a.tab")])
        assert rows.rdd.getNumPartitions() > 2
        ids = [r["id"] for r in rows.orderBy("line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ids == sorted(ids) and len(ids) == 30_005
