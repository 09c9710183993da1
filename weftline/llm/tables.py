"""Small shared helpers: reading a table, cutting lineage, Arrow columns in tasks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine without one, a temporary folder.

    A cluster that names none in ``spark.checkpoint.dir`` raises, as a machine's own folder
    would not be seen by the others.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it from there.

    The folder is the cluster's ``spark.checkpoint.dir``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle and checkpoint files of what is no longer referred to.

    It does so when the driver's garbage is collected, which a small driver heap's pace may
    leave for long, while jobs in rounds write more.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python workers ``rows`` rows at a time at most, from now on in this session.

    What a worker and its executor hold at once follows the bytes of a batch, and whole
    texts are long.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def release_memory() -> None:
    """Give back what a Python worker no longer uses, as it is kept for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def key_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow string column; a null text is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]
