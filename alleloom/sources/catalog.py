"""The catalog of datasets, as small DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from . import files

CORRELATIONS = (("r", "Pearson correlation", "LD"), ("rsquare", "squared correlation", "LD"), ("rsquare_approx", "squared correlation from bit counts", "LD"), ("cov", "covariance", "LD"))
KINDS = ("genotypes", "phenotypes", "summary_stats", "masks")
LINKS = ("genotypes", "summary_stats")
#: What entries of a YAML catalog may say.
COLUMN_TYPES, GROUP_TYPES, IDENTIFIER_TYPES = ("TEXT", "CATEGORICAL", "INTEGER", "FLOAT"), ("GENE", "REGION"), ("ENSEMBL", "COORDINATES")
FORMATS = ("RAREMETAL", "RVTEST", "METASTAAR")


def expand(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a path or a pattern names, in order, looked up where Spark reads them; none is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(str(f.getPath()) for f in store.globStatus(at) or [])
    if not found:
        raise QueryError("a catalog names files that are not there", pattern)
    return found if any(c in pattern for c in "*?[{") else [pattern]


@dataclass
class Catalog:
    """Datasets by kind and id; subsets of samples and files of chromosomes as tables."""

    spark: SparkSession
    datasets: dict[tuple[str, str], dict] = field(default_factory=dict)
    subsets: list[tuple[str, DataFrame]] = field(default_factory=list)
    blocks: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, kind: str, entry: dict) -> str:
        """Registers a dataset; ids are unique within a kind, and what it names must be there already."""
        if kind not in KINDS:
            raise QueryError(f"unknown dataset kind {kind}")
        key = (kind, str(entry.get("id", entry.get("name"))))
        if key in self.datasets:
            raise QueryError(f"{kind} has the id {key[1]} twice")
        for link in LINKS:
            for other in entry.get(link) or [] if kind != link else []:
                if (link, str(other)) not in self.datasets:
                    raise QueryError(f"{kind} {key[1]} names unknown {link} {other}")
        named = entry.get("filepath") or entry.get("files") or []
        self.datasets[key] = entry | {"paths": [p for f in ([named] if isinstance(named, str) else named) for p in (sorted(glob(f)) or [f])]}
        return key[1]

    def add_genotypes(self, entry: dict, samples: DataFrame | None = None) -> None:
        """Genotype files with their samples as the subset ALL: those given, else those that all of the files name alike."""
        key = self.add("genotypes", entry)
        try:
            everyone = samples if samples is not None else files.same_samples(self.spark, self.datasets["genotypes", key]["paths"])
            if not everyone.take(1):
                raise QueryError("a genotype dataset has no samples", str(self.datasets["genotypes", key]["paths"]))
        except QueryError:
            del self.datasets["genotypes", key]
            raise
        self.add_subsets(key, everyone.select(F.lit("ALL").alias("subset"), "sample"))

    def add_blocks(self, entry: dict, scores: list[str], covariances: list[str]) -> None:
        """A summary statistic dataset of block files, with the manifest that finds a region's blocks."""
        from ..operators.sumstats import block_pairs

        key = self.add("summary_stats", entry | {"files": [*scores, *covariances]})
        self.blocks[key] = block_pairs(files.block_manifest(self.spark, scores), files.block_manifest(self.spark, covariances))

    def blocks_of(self, dataset: str, chrom: str, start: int, stop: int) -> DataFrame:
        """The blocks of a dataset that a region needs."""
        from ..operators.sumstats import blocks_of_region

        return blocks_of_region(self.blocks[self.known("summary_stats", dataset)], chrom, start, stop)

    def known(self, kind: str, dataset: str) -> str:
        if (kind, str(dataset)) not in self.datasets:
            raise QueryError(f"no {kind} dataset {dataset}")
        return str(dataset)

    def add_subsets(self, dataset: str, rows: DataFrame) -> None:
        """Appends ``(subset, sample)`` rows."""
        self.subsets.append((dataset, rows.select("subset", F.col("sample").cast("string").alias("sample"))))

    def add_samples(self, dataset: str, subset: str, names: list[str], replace: bool = False) -> None:
        """Appends to a subset, or replaces it."""
        if replace:
            self.subsets = [(d, rows.where(F.col("subset") != subset) if d == dataset else rows) for d, rows in self.subsets]
        self.add_subsets(dataset, self.spark.createDataFrame([(subset, n) for n in names], "subset string, sample string"))

    def load_yaml(self, path: str) -> None:
        """Blocks in the order in which they may name each other."""
        import yaml

        with open(path) as f:
            blocks = yaml.safe_load(f) or {}
        for kind in KINDS:
            for entry in blocks.get(kind) or []:
                self.add(kind, entry)

    def register_yaml(self, path: str) -> None:
        """Registers all that a YAML catalog lists, or nothing: ids, types and files are checked first.

        Patterns are looked up where Spark reads. Genotype datasets get their samples (a list, a file of names, or those that all files name
        alike) as the subset ALL; phenotypes the kinds of their columns, stated or found, and some sample of a genotype dataset that they name; block files
        their manifest. Masks and others must say known types.
        """
        import yaml

        text = "\n".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect())  # a catalog
        listed = yaml.safe_load(text) or {}
        if unknown := set(listed) - set(KINDS):
            raise QueryError(f"unknown blocks in a catalog: {', '.join(sorted(map(str, unknown)))}")
        new = Catalog(self.spark, dict(self.datasets), list(self.subsets), dict(self.blocks))
        for kind in KINDS:
            for entry in listed.get(kind) or []:
                getattr(new, f"_register_{kind}")(entry)
        self.datasets, self.subsets, self.blocks = new.datasets, new.subsets, new.blocks

    def _paths(self, entry: dict, name: str) -> list[str]:
        named = entry.get(name)
        if not named:
            raise QueryError(f"{entry.get('name')} lacks {name}")
        return [p for pattern in ([named] if isinstance(named, str) else named) for p in expand(self.spark, pattern)]

    def _register_genotypes(self, entry: dict) -> None:
        samples = entry.get("samples")
        if isinstance(samples, str):
            samples = files.read_sample_list(self.spark, samples)
        elif samples is not None:
            samples = self.spark.createDataFrame([(str(x),) for x in samples], "sample string")
        self.add_genotypes(entry | {"filepath": self._paths(entry, "filepath")}, samples)

    def _register_phenotypes(self, entry: dict) -> None:
        from ..operators.phenotypes import infer_kinds

        stated = {c: (x or {}).get("type") for c, x in (entry.get("columns") or {}).items()}
        if wrong := {x for x in stated.values() if x is not None and x not in COLUMN_TYPES}:
            raise QueryError(f"unknown column types: {', '.join(sorted(map(str, wrong)))}")
        paths = self._paths(entry, "filepath")
        if paths[0].endswith(".ped"):
            rows, first = files.read_ped(self.spark, paths[0], f"{paths[0][:-4]}.dat"), "iid"
        else:
            rows = files.read_tab(self.spark, paths)
            first = rows.columns[0]
        columns = [c for c in rows.columns if c not in ("line", first)]
        if lacking := [c for c in stated if c not in rows.columns]:
            raise QueryError(f"a phenotype file lacks the columns {', '.join(lacking)}", paths[0])
        found = {r["column"]: r["kind"] for r in infer_kinds(rows, columns, "line").collect()} if columns else {}
        kinds = {c: stated.get(c) or found.get(c, "TEXT") for c in columns}
        for other in entry.get("genotypes") or []:
            if not rows.select(F.col(f"`{first}`").alias("sample")).join(self.samples(self.known("genotypes", other)), "sample", "left_semi").take(1):
                raise QueryError(f"phenotypes share no sample with genotypes {other}", paths[0])
        self.add("phenotypes", entry | {"filepath": paths, "kinds": kinds})

    def _register_summary_stats(self, entry: dict) -> None:
        if entry.get("format") not in (None, *FORMATS):
            raise QueryError(f"unknown summary statistics format {entry['format']}")
        scores, covariances = self._paths(entry, "score_path"), self._paths(entry, "cov_path")
        if entry.get("format") == "METASTAAR":
            self.add_blocks(entry, scores, covariances)
        else:
            kind = entry.get("format") or files.sniff_format(self.spark, scores[0])
            self.add("summary_stats", entry | {"files": [*scores, *covariances], "format": kind, "scores": scores, "covariances": covariances})

    def _register_masks(self, entry: dict) -> None:
        for what, known in (("group_type", GROUP_TYPES), ("identifier_type", IDENTIFIER_TYPES)):
            if entry.get(what) not in known:
                raise QueryError(f"unknown {what} {entry.get(what)}")
        self.add("masks", entry | {"filepath": self._paths(entry, "filepath")})

    def register_json(self, path: str) -> None:
        """Registers the references of a JSON catalog as genotype datasets under their names, with their subsets of samples; all or none."""
        rows = [r for r in read_json_catalog(self.spark, path).collect() if r["name"] is not None]
        new = Catalog(self.spark, dict(self.datasets), list(self.subsets), dict(self.blocks))
        for name in dict.fromkeys(r["name"] for r in rows):
            own = [r for r in rows if r["name"] == name]
            named = [p for f in dict.fromkeys(r["file"] for r in own if r["file"]) for p in expand(self.spark, f)]
            new.add("genotypes", {"id": name, "name": name, "description": own[0]["description"], "genome_build": own[0]["genome_build"], "files": named})
            for subset, samples in {r["subset"]: r["samples"] for r in own if r["subset"]}.items():
                new.add_samples(name, subset, samples or [])
        self.datasets, self.subsets, self.blocks = new.datasets, new.subsets, new.blocks

    def links(self) -> DataFrame:
        """``(kind, id, other_kind, other)``: which datasets name which."""
        rows = [(kind, i, link, str(other)) for (kind, i), e in self.datasets.items() for link in LINKS if link != kind for other in e.get(link) or []]
        return self.spark.createDataFrame(rows, "kind string, id string, other_kind string, other string")

    def linked(self, kind: str, other_kind: str, other: str) -> DataFrame:
        """The datasets of a kind that go with another dataset."""
        own = self.links().where((F.col("kind") == kind) & (F.col("other_kind") == other_kind) & (F.col("other") == self.known(other_kind, other)))
        return self.frame().join(own.select("kind", "id").distinct(), ["kind", "id"], "left_semi")

    def frame(self) -> DataFrame:
        rows = [(k, i, e.get("name"), e.get("description"), e.get("genome_build"), e["paths"]) for (k, i), e in self.datasets.items()]
        return self.spark.createDataFrame(rows, "kind string, id string, name string, description string, genome_build string, paths array<string>")

    def references(self, genome_build: str | None = None) -> DataFrame:
        """``(id, name, description, genome_build)`` of the genotype datasets, or of those of a build."""
        rows = self.frame().where("kind = 'genotypes'").select("id", "name", "description", "genome_build")
        return rows if genome_build is None else rows.where(F.col("genome_build") == genome_build)

    def files(self, kind: str, dataset: str) -> DataFrame:
        return self.frame().where((F.col("kind") == kind) & (F.col("id") == self.known(kind, dataset))).select(F.explode("paths").alias("path"))

    def chromosomes(self, dataset: str) -> DataFrame:
        """``(chrom)`` of a genotype dataset's files."""
        paths = self.datasets["genotypes", self.known("genotypes", dataset)]["paths"]
        rows = files.vcf_variants(self.spark, paths) if paths[0].endswith((".vcf", ".vcf.gz", ".bcf")) else files.read_calls(self.spark, paths)
        return rows.select("chrom").distinct()

    def samples(self, dataset: str, subset: str = "ALL") -> DataFrame:
        """``(sample)``; an unknown subset has none."""
        own = [rows.where(F.col("subset") == subset).select("sample") for d, rows in self.subsets if d == dataset]
        return reduce(DataFrame.unionByName, own, self.spark.createDataFrame([], "sample string")).distinct()

    def populations(self, dataset: str) -> DataFrame:
        """``(subset, n_samples)``."""
        own = [rows for d, rows in self.subsets if d == dataset]
        rows = reduce(DataFrame.unionByName, own, self.spark.createDataFrame([], "subset string, sample string"))
        return rows.groupBy("subset").agg(F.countDistinct("sample").alias("n_samples"))

    def genome_builds(self) -> DataFrame:
        return self.frame().where("genome_build is not null").select("genome_build").distinct()

    def correlations(self) -> DataFrame:
        return self.spark.createDataFrame(CORRELATIONS, "name string, description string, type string")


def read_json_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``(name, description, genome_build, file, subset, samples)`` rows of a JSON catalog."""
    schema = "Name string, Description string, `Genome build` string, Files array<string>, Samples map<string, array<string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.col("Name").alias("name"), F.col("Description").alias("description"), F.col("`Genome build`").alias("genome_build"), F.explode_outer("Files").alias("file"), "Samples").select("name", "description", "genome_build", "file", F.explode_outer("Samples").alias("subset", "samples"))
