"""What the operators of this subpackage share: tables in, scratch tables, worker-side caches."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run on executors travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: A word is a run of anything but these bytes; the class is the same in Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts per Arrow batch: a batch of very long texts must still fit a small Python worker.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and has no other machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="slopeworks-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Cuts the lineage at a place every executor can reach and fixes row numbers that a
    recomputation could deal out differently.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker process, kept from task to task."""
    held = sys.__dict__.setdefault("_slopeworks_worker_cache", {})
    if name not in held:
        held[name] = make()
    return held[name]


def held_out(doc_id: Column) -> Column:
    """True for the third of the rows whose labels are never learned from (null id: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """One label per document: rows with a null id or label go; of contradicting rows the larger stays."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
