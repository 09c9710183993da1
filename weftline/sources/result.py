"""A matrix as tables on disk: its entries in order, and where each row begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.matrix import prefix_sum, row_pointers
from weftline.operators.product import summed
from weftline.sources.words import CsrSource, write_words


def write_csr(m: DataFrame, path: str) -> None:
    """Write (i, j, v) in ranges of rows, each a file in order, under ``entries``, where each file begins under ``files``, and (i, n, ptr) under ``rows``."""
    order = [F.col("i").asc_nulls_last(), F.col("j").asc_nulls_last()]
    # finding the ranges takes a look at all of it, from the last shuffle on
    m.select("i", "j", "v").repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/entries")
    entries = m.sparkSession.read.parquet(f"{path}/entries")
    # nulls come last, here too
    first = F.min(F.struct(F.col("i").isNull(), "i", F.col("j").isNull(), "j")).alias("first")
    files = entries.groupBy(F.col("_metadata.file_name").alias("file")).agg(first, F.count("*").alias("n"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # of one row a file
    files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at")).write.parquet(f"{path}/files")
    row_pointers(entries).write.parquet(f"{path}/rows")


def write_counted(a: DataFrame, b: DataFrame, path: str) -> dict[str, int]:
    """Write the product (i, j, v) under ``path`` and return its partials, entries and longest sums, which the writing pass itself observes."""
    written = Observation()
    counts = [F.coalesce(F.sum("n"), F.lit(0)).alias("partials"), F.count(F.lit(1)).alias("entries"), F.max("n").alias("most")]
    summed(a, b).observe(written, *counts).drop("n").write.parquet(path)
    return written.get


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v, pos): the entries with their places among all, which are the files' and those in them; nothing is shuffled or ordered anew."""
    placed = spark.read.parquet(f"{path}/entries").select("i", "j", "v", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("nth"))
    files = F.broadcast(spark.read.parquet(f"{path}/files"))
    return placed.where("i IS NOT NULL").join(files, "file").select("i", "j", "v", (F.col("at") + F.col("nth")).alias("pos"))


def write_files(m: DataFrame, path: str) -> None:
    """Write (i, j, v) as files of words: ``col_indices`` (u4) and ``values`` (f4) in order, ``row_ptrs`` (u8) of the rows that have entries and the end."""
    write_csr(m, f"{path}/tables")
    spark = m.sparkSession
    entries, rows = read_csr(spark, f"{path}/tables"), spark.read.parquet(f"{path}/tables/rows")
    write_words(entries.select(F.col("pos").alias("word"), F.col("j").alias("value")), f"{path}/col_indices", ordered=True)
    write_words(entries.select(F.col("pos").alias("word"), F.col("v").alias("value")), f"{path}/values", "f4", ordered=True)
    starts = prefix_sum(rows.select("i", "ptr", F.lit(1).alias("_one")), "i", "_one", "word").select(F.col("word").cast("long").alias("word"), F.col("ptr").alias("value"))
    end = rows.agg(F.count("*").alias("word"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("value"))
    write_words(starts.unionByName(end), f"{path}/row_ptrs", "u8")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(row, pos, j, v) of such files: the row's number among those with entries, and each entry's place; tasks read stretches of entries and the pointers of their rows."""
    spark.dataSource.register(CsrSource)
    return spark.read.format("csr_words").load(path)
