"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: The six ASCII white-space bytes between words; ``bytes.split()`` splits at the same.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session, where all share one machine, gets a folder of its own."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="alleloom-"))


#: Lists that note the tables written while they are open, innermost last.
_NOTED: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that are written within."""
    made: list[str] = []
    _NOTED.append(made)
    try:
        yield made
    finally:
        _NOTED.remove(made)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    for made in _NOTED:
        made.append(path)
    return path


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder; only when no DataFrame that reads them is still to be run."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from a batch to a dict of columns, in the schema's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out = make(piece)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose buffers hold about ``limit`` bytes at most (one row at least)."""
    rows, total = batch.num_rows, batch.nbytes
    step = max(1, rows * limit // max(total, 1)) if total > limit else max(rows, 1)
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def documents(df: DataFrame, id_col: str, text_col: str, binary: bool = True) -> DataFrame:
    """Only ``doc_id`` and ``text``; as UTF-8 bytes for Python stages."""
    ship(df.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (text.cast("binary") if binary else text).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
