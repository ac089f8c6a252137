"""Text files of genotypes, phenotypes, masks and summary statistics."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.variants import alt_frequency, colons_to_epacts, epacts, leading_number, parse, segment
from ..operators.genotype import STORED
from ..operators.intervals import overlaps
from ..shipping import ship
from .indexed import block_gzipped, read_lines
from .stores import at_any_place, exists, first_lines

#: 0-based columns of the two score file formats.
SCORE_COLUMNS = {
    "RVTEST": {"chrom": 0, "pos": 1, "ref": 2, "alt": 3, "n": 4, "af": 5, "ac": 6, "u": 12, "sqrt_v": 13, "pvalue": 15},
    "RAREMETAL": {"chrom": 0, "pos": 1, "ref": 2, "alt": 3, "n": 4, "af": 5, "ac": 7, "u": 13, "sqrt_v": 14, "pvalue": 16},
}
#: 0-based columns of the two covariance file formats.
COV_COLUMNS = {"RVTEST": {"chrom": 0, "pos": 1, "positions": 4, "covs": 5}, "RAREMETAL": {"chrom": 0, "pos": 1, "positions": 2, "covs": 3}}


def _fields(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    lines = spark.read.text(path).select("value", _line().alias("line")).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(F.split("value", sep).alias("f"), "line")


def _pick(columns: dict[str, int]) -> list[Column]:
    return [F.get("f", F.lit(i)).alias(k) for k, i in columns.items()]


def _line() -> Column:
    """The place of a row's line: by the file's path, the place in the file of the task's part, and the row in that part."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def _head(spark: SparkSession, path: str) -> DataFrame:
    """``value``: a file's lines up to its first data row; of a store that only Spark opens, all lines."""
    lines = first_lines(path, lambda x: x.strip() != "" and not x.startswith("#") and not x.upper().startswith("CHROM"))
    return spark.read.text(path) if lines is None else spark.createDataFrame([(x,) for x in lines], "value string")


def sniff_format(spark: SparkSession, path: str) -> str:
    """RVTEST or RAREMETAL: by the program named in the header, else by the header's column names.

    Only the header is read; another program, or none and unknown columns, is an error.
    """
    text = _head(spark, path)
    program = F.regexp_extract("value", r"^##ProgramName=(\w+)", 1)
    upper = F.upper(F.col("value"))
    head = text.where(F.col("value").startswith("#") | F.upper(F.col("value")).startswith("CHROM"))
    seen = head.agg(
        F.max(F.nullif(program, F.lit(""))).alias("program"),
        F.max(upper.rlike("FOUNDER_AF|MARKERS_IN_WINDOW|CURRENT_POS")).alias("raremetal"),
        F.max(upper.rlike("N_INFORMATIVE|START_POS")).alias("rvtest"),
    ).first()
    if seen["program"]:
        kinds = {"Rvtests": "RVTEST", "RareMetalWorker": "RAREMETAL"}
        if seen["program"] not in kinds:
            raise QueryError(f"unknown program {seen['program']} in the header of a score file", path)
        return kinds[seen["program"]]
    if seen["raremetal"] or seen["rvtest"]:
        return "RAREMETAL" if seen["raremetal"] else "RVTEST"
    raise QueryError("unknown summary statistics format", path)


def header_scalars(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``sigma2`` and ``nsamples`` from the header; samples else from the first data row."""
    text = _head(spark, path)
    found = text.where(F.col("value").startswith("#")).agg(
        F.max(F.regexp_extract("value", r"^## - Sigma2\s*=?\s*(\S+)", 1).try_cast("double")).alias("a"),
        F.max(F.regexp_extract("value", r"^##\s*Sigma_e2_Hat\s*[=\t ]\s*(\S+)", 1).try_cast("double")).alias("b"),
        F.max(F.regexp_extract("value", r"^##\s*AnalyzedSamples\s*=\s*(\d+)", 1).try_cast("bigint")).alias("n"),
    )
    first = text.where(~F.col("value").startswith("#") & ~F.col("value").startswith("CHROM")).select(leading_number(F.get(F.split("value", "\t"), F.lit(4))).cast("bigint").alias("m")).limit(1)
    return found.join(first, how="left").select(F.coalesce("a", "b").alias("sigma2"), F.coalesce("n", "m").alias("nsamples"))


def read_scores(spark: SparkSession, path: str | list[str], kind: str | None = None) -> DataFrame:
    """``(line, chrom, pos, variant, alt_freq, n, score_stat, sqrt_v, pvalue)``; U that is no number is an error."""
    kind = kind or sniff_format(spark, path if isinstance(path, str) else path[0])
    rows = _fields(spark, path).select("line", *_pick(SCORE_COLUMNS[kind])).where(~F.col("chrom").isin("CHROM"))
    u = leading_number(F.col("u"))
    u = F.when(u.isNull(), F.raise_error(F.concat(F.lit("U_STAT is no number at "), "chrom", F.lit(":"), "pos")).cast("double")).otherwise(u)
    return rows.select(
        "line", "chrom", F.col("pos").cast("bigint").alias("pos"), epacts(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("variant"),
        alt_frequency(F.col("af"), F.col("ac"), F.col("n")).alias("alt_freq"), leading_number(F.col("n")).cast("bigint").alias("n"), u.alias("score_stat"), leading_number(F.col("sqrt_v")).alias("sqrt_v"), leading_number(F.col("pvalue")).alias("pvalue"),
    )


def read_covariances(spark: SparkSession, path: str | list[str], kind: str | None = None) -> DataFrame:
    """``(chrom, pos, positions, covs)``, lists still as text."""
    kind = kind or sniff_format(spark, path if isinstance(path, str) else path[0])
    return _fields(spark, path).select(*_pick(COV_COLUMNS[kind])).where(F.col("chrom") != "CHROM").withColumn("pos", F.col("pos").cast("bigint"))


def read_mask(spark: SparkSession, path: str | list[str], chrom: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """``(group, chrom, start, stop, pos, variant)``: one row for each member; all groups, or those that meet a region."""
    rows = _fields(spark, path).select(F.col("f")[0].alias("group"), F.col("f")[1].alias("chrom"), F.col("f")[2].cast("bigint").alias("start"), F.col("f")[3].cast("bigint").alias("stop"), F.expr("slice(f, 5, greatest(size(f) - 4, 0))").alias("members"))
    if chrom is not None:
        rows = rows.where((F.col("chrom") == chrom) & (F.col("start") <= stop) & (F.col("stop") >= start))
    return rows.select("group", "chrom", "start", "stop", F.explode("members").alias("variant")).where("variant <> ''").withColumn("pos", parse(F.col("variant"))["pos"])


def group_bounds(members: DataFrame) -> DataFrame:
    """Members with their group's bounds, the least and greatest position."""
    bounds = members.groupBy("group", "chrom").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
    return members.join(bounds, ["group", "chrom"]).select("group", "chrom", "start", "stop", "variant", "pos")


def mask_of(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """The same from a request, names in either notation; a group's bounds are its members'."""
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "group string, variant string")
    return group_bounds(rows.select("group", colons_to_epacts(F.col("variant")).alias("variant")).select("group", "variant", parse(F.col("variant")).alias("p")).select("group", "p.chrom", "p.pos", "variant"))


def region_groups(groups: DataFrame, variants: DataFrame) -> DataFrame:
    """Members of groups given as regions; groups and variants meet in bins."""
    return overlaps(groups.select("group", "chrom", "start", "stop"), variants.select("chrom", "variant", "pos")).select("group", "chrom", "start", "stop", "variant", "pos")


def covariance_positions(cov: DataFrame) -> int:
    """How many different positions covariances name."""
    named = F.concat(F.array("pos"), F.transform(F.coalesce(F.split("positions", ","), F.array()), lambda p: p.try_cast("bigint")))
    both = cov.select("chrom", F.explode(F.array_distinct(named)).alias("pos"))  # one reading of the rows
    return both.dropna().distinct().count()


def read_tab(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A phenotype table with a header: its columns as text and ``line``, in the order of the file; ``#`` and blank lines are skipped."""
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False, comment="#", quote="")
    return rows.select("*", _line().alias("line"))


#: Kinds of columns in a pedigree's ``.dat`` file; markers are no phenotypes.
DAT_KINDS = {"A": "CATEGORICAL", "T": "FLOAT", "M": None}
PEDIGREE = ("fid", "iid", "pid", "mid", "sex")


def dat_columns(spark: SparkSession, dat: str) -> list[tuple[str, str | None]]:
    """``(name, kind)`` of a pedigree's further columns; an unknown letter is an error."""
    lines = [r["value"].split() for r in spark.read.text(dat).where(F.trim("value") != "").collect()]
    for line in lines:
        if len(line) != 2 or line[0] not in DAT_KINDS:
            raise QueryError("a line of a .dat file is no column", f"{dat}: {' '.join(line)}")
    return [(name, DAT_KINDS[kind]) for kind, name in lines]


def read_ped(spark: SparkSession, path: str, dat: str) -> DataFrame:
    """A pedigree file with the columns that its ``.dat`` file names, as text; columns of markers take a place but are left out."""
    columns = [*[(c, "TEXT") for c in PEDIGREE], *dat_columns(spark, dat)]
    rows = _fields(spark, path, r"\s+")
    return rows.select(*[F.get("f", F.lit(i)).alias(c) for i, (c, kind) in enumerate(columns) if kind], "line")


def read_sample_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("sample")).where("sample <> ''")


def _lines(spark: SparkSession, path: str | list[str], chrom: str | None = None, start: int | None = None, stop: int | None = None, header: bool = False) -> DataFrame:
    """``path, value``: block-gzipped files by their blocks and index, all others by Spark's reader of text."""
    paths = [path] if isinstance(path, str) else list(path)
    packed = [p for p in paths if block_gzipped(p)]
    plain = [p for p in paths if p not in packed]
    out = read_lines(spark, packed, chrom, start, stop, header) if packed else None
    if plain:
        text = spark.read.text(plain).select(F.input_file_name().alias("path"), "value")
        out = text if out is None else out.unionByName(text)
    return out


def vcf_samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, idx, sample)`` from each file's header line."""
    head = _lines(spark, path, header=True).where(F.col("value").startswith("#CHROM")).select("path", F.split("value", "\t").alias("f"))
    return head.select("path", F.posexplode(F.expr("slice(f, 10, greatest(size(f) - 9, 0))")).alias("idx", "sample"))


def same_samples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The samples of a dataset of many files; files with others than the rest are an error."""
    named = vcf_samples(spark, paths)
    files = named.select("path").distinct().count()
    partial = named.groupBy("sample").agg(F.countDistinct("path").alias("m")).where(F.col("m") != files).limit(1).collect()
    if partial or files != len(set(paths)):
        raise QueryError("the genotype files differ in their samples", ", ".join(paths))
    return named.select("sample").distinct()


def _records(spark: SparkSession, path: str | list[str], chrom: str | None, start: int | None, stop: int | None) -> DataFrame:
    """A row for each alternate allele of a record, with the genotypes still as text."""
    lines = _lines(spark, path, chrom, start, stop).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select("path", F.split("value", "\t").alias("f"))
    if chrom is not None:
        lines = lines.where((F.col("f")[0] == chrom) & F.col("f")[1].cast("bigint").between(start, stop))
    rows = lines.select("path", F.col("f")[0].alias("chrom"), F.col("f")[1].cast("bigint").alias("pos"), F.col("f")[3].alias("ref"), F.posexplode(F.split(F.col("f")[4], ",")).alias("k", "alt"), F.expr("slice(f, 10, greatest(size(f) - 9, 0))").alias("g"))
    return rows.withColumn("variant", epacts(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))


def vcf_variants(spark: SparkSession, path: str | list[str], chrom: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """``(chrom, pos, variant)`` of all records, those included that nobody carries."""
    return _records(spark, path, chrom, start, stop).select("chrom", "pos", "variant")


def read_vcf(spark: SparkSession, path: str | list[str], chrom: str | None = None, start: int | None = None, stop: int | None = None, haplotypes: bool = False) -> DataFrame:
    """Calls of VCFs (plain, block-gzipped or binary): a row for each carried or missing count, one for each alternate allele.

    With ``haplotypes`` a row for each carried or missing allele, with ``hap`` its place in the genotype: correlations
    other than covariances are over these. Each file's own header names its samples. Of a block-gzipped file with a
    tabix or CSI index (``<path>.tbi``, ``<path>.csi``) a region reads its own blocks only, and without a region it is split into many tasks; another
    gzip file is read by one task.
    """
    rows = _records(spark, path, chrom, start, stop).select("path", "chrom", "pos", "variant", "k", F.posexplode("g").alias("idx", "g"))
    rows = rows.where(~F.col("g").isin(*CARRIES_NONE))  # nearly all of a file, told without taking it apart
    alleles = F.split(F.split("g", ":")[0], r"[/|]")
    own = (F.col("k") + 1).cast("string")
    if haplotypes:
        each = rows.select("path", "chrom", "pos", "variant", "k", "idx", F.posexplode(alleles).alias("hap", "a"))
        called = each.where((F.col("a") == (F.col("k") + 1).cast("string")) | (F.col("a") == ".")).withColumn("dosage", F.when(F.col("a") != ".", 1e0))
    else:
        count = F.size(F.filter(alleles, lambda a: a == own)).cast("double")
        called = rows.withColumn("dosage", F.when(~F.exists(alleles, lambda a: a == "."), count)).where("dosage is null or dosage > 0")
    named = called.join(vcf_samples(spark, path), ["path", "idx"])
    return named.select("chrom", "pos", "variant", "sample", *(["hap"] if haplotypes else []), "dosage")


#: Genotypes that give no row.
CARRIES_NONE = ("0/0", "0|0", "0")
CALLS = "pos long, variant string, sample string, {hap}dosage double, chrom string, segment long"


def open_genotypes(spark: SparkSession, path: str, haplotypes: bool = False) -> DataFrame:
    """By the file's ending: VCF as text or binary (BCF), or calls stored by ``write_calls``. SAV files must be converted first."""
    if path.endswith((".vcf", ".vcf.gz")) or path.endswith(".bcf") and block_gzipped(path):
        return read_vcf(spark, path, haplotypes=haplotypes)
    if path.endswith(".parquet"):
        return read_calls(spark, path, haplotypes)
    raise QueryError("unsupported genotype file", path)


def write_calls(calls: DataFrame, path: str) -> None:
    """Parquet by chromosome and segment, so a region's scan prunes to its folders and, within, by position."""
    stored = calls.withColumn("segment", segment(F.col("pos"), STORED))
    stored.repartition("chrom", "segment").sortWithinPartitions("pos", "variant").write.partitionBy("chrom", "segment").parquet(path)


def read_calls(spark: SparkSession, path: str, haplotypes: bool = False) -> DataFrame:
    """Calls stored by ``write_calls``; with the schema given, chromosomes stay text. ``in_region`` prunes to their folders."""
    return spark.read.schema(CALLS.format(hap="hap int, " if haplotypes else "")).parquet(path)


def footer(path: str, file) -> dict:
    """A block file's row of the manifest, from the footer of an open Parquet file."""
    import pyarrow.parquet as pq

    parquet = pq.ParquetFile(file)
    meta = {k.decode(): v.decode() for k, v in (parquet.schema_arrow.metadata or {}).items()}
    number = {k: int(meta[k]) if meta.get(k, "").lstrip("-").isdigit() else None for k in ("pos_start", "pos_mid", "pos_end", "region_start", "region_mid", "region_end", "nrows", "ncols")}
    sizes = {"nrows": number.pop("nrows") or parquet.metadata.num_rows, "ncols": number.pop("ncols") or parquet.metadata.num_columns}
    cutoff = meta.get("cov_maf_cutoff", "")
    return {"path": path, "chrom": meta.get("chrom"), **number, **sizes, "cutoff": float(cutoff) if cutoff else None}


def block_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per block file from the key-value metadata in its footer, which Spark's reader doesn't show.

    The footers are read in tasks, by seeking to them, so of a file of any size only its last bytes are read; where the store
    can't be opened so, whole files come through Spark's own reader. ``nrows`` and ``ncols`` come from the metadata, else from the footer.
    """
    ship(spark)

    def footers(batches):
        import io

        import pandas as pd

        for batch in batches:
            rows = []
            for row in batch.itertuples():
                if hasattr(row, "content"):
                    rows.append(footer(row.path, io.BytesIO(row.content)))
                else:
                    with at_any_place(row.path) as file:
                        rows.append(footer(row.path, file))
            yield pd.DataFrame(rows, columns=MANIFEST_COLUMNS)

    if all(exists(p) for p in paths[:1]):
        named = [p if re.match(r"\w+:/", p) else f"file:{os.path.abspath(p)}" for p in paths]
        files = spark.createDataFrame([(p,) for p in named], "path string").repartition(max(1, min(len(paths), 200)))
    else:
        files = spark.read.format("binaryFile").load(paths).select("path", "content")
    found = files.mapInPandas(footers, MANIFEST)
    needed = ("chrom", "pos_start", "pos_end", "region_start", "region_mid", "region_end")
    lacking = found.where(" or ".join(f"{c} is null" for c in needed)).select("path").limit(1).collect()
    if lacking:
        raise QueryError("a block file lacks metadata", lacking[0]["path"])
    return found


MANIFEST_COLUMNS = ["path", "chrom", "pos_start", "pos_mid", "pos_end", "region_start", "region_mid", "region_end", "nrows", "ncols", "cutoff"]
MANIFEST = ", ".join(f"{c} {'string' if c in ('path', 'chrom') else 'double' if c == 'cutoff' else 'long'}" for c in MANIFEST_COLUMNS)
#: The first columns of a score block, in order; covariate sums follow.
BLOCK_COLUMNS = ("chrom", "pos", "ref", "alt", "alt_ac", "mac", "maf", "n", "u", "v")


def read_blocks(spark: SparkSession, paths: list[str], manifest: DataFrame | None = None) -> DataFrame:
    """Score blocks with their covariate sums as one array, however many columns there are.

    With a manifest of blocks (``sumstats.block_pairs``) each row has its block's number and cutoff and its variant.
    """
    rows = spark.read.parquet(*paths)
    fixed = rows.columns[:10]
    out = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(fixed, BLOCK_COLUMNS, strict=True)], F.array(*[F.col(f"`{c}`").cast("double") for c in rows.columns[10:]]).alias("gtu"), F.input_file_name().alias("path"))
    out = out.withColumn("chrom", F.col("chrom").cast("string")).withColumn("pos", F.col("pos").cast("long"))
    if manifest is None:
        return out
    own = manifest.select(_plain("path").alias("path"), "block", "cutoff")
    return out.withColumn("path", _plain("path")).join(own, "path").withColumn("variant", epacts(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))


def read_block_covariances(spark: SparkSession, paths: list[str], manifest: DataFrame) -> DataFrame:
    """``(block, row, col, gtg)``: sparse products of genotypes, by places from the block's start."""
    rows = spark.read.parquet(*paths)
    names = dict(zip(("row", "col", "gtg"), rows.columns[:3], strict=True))
    out = rows.select(*[F.col(f"`{c}`").cast("double" if k == "gtg" else "long").alias(k) for k, c in names.items()], _plain(F.input_file_name()).alias("path"))
    return out.join(manifest.select(_plain("cov_path").alias("path"), "block"), "path").select("block", "row", "col", "gtg")


def _plain(path: str | Column) -> Column:
    """A path without the slashes by which readers differ after the scheme."""
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, "^(\\w+:)/+", "$1/")
