"""Partition metadata on disk: Parquet of the records, and the packed word format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str) -> None:
    """(blk, word, value) as Parquet, a row a record: blk and the words in order."""
    records.groupBy("blk").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "value"))), lambda w: w["value"]).alias("words")).write.parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``write_records`` as (blk, word, value)."""
    return spark.read.parquet(path).select("blk", F.posexplode("words").alias("word", "value")).select("blk", F.col("word").cast("long").alias("word"), "value")


def split_lines(cuts: DataFrame, offsets: DataFrame) -> DataFrame:
    """Text lines ``row f offset direction`` of the cuts; ``offsets`` (blk, off) says where each split vector begins."""
    return cuts.join(offsets, "blk").select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("i", "f", "off", "reverse")]).alias("value"))


def _flipped(word):
    """Eight hex digits of a 32-bit word, its lowest byte first."""
    digits = F.lpad(F.hex(word), 8, "0")
    return F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])


def export_words(records: DataFrame, offsets: DataFrame, path: str) -> None:
    """Write the records as little-endian 32-bit words: Parquet of (blk, ptr, words), ``ptr`` the record's first word.

    Parts are ranges of blocks and each lies in order, so that the parts' words one after
    another are the words of all records.
    """
    words = records.groupBy("blk").agg(F.array_sort(F.collect_list(F.struct("word", "value"))).alias("w"))
    packed = words.select("blk", F.unhex(F.array_join(F.transform("w", lambda x: _flipped(x["value"])), "")).alias("words"))
    packed.join(offsets, "blk").select("blk", "ptr", "words").repartitionByRange("blk").sortWithinPartitions("blk").write.parquet(path)


def import_words(spark: SparkSession, path: str) -> DataFrame:
    """(blk, word, value) of the words under ``path``."""
    at = F.explode(F.sequence(F.lit(0), (F.octet_length("words") / 4).cast("int") - 1)).alias("at")
    word = spark.read.parquet(path).where(F.octet_length("words") > 0).select("blk", "words", at)
    value = F.conv(_flipped_back(F.hex(F.substring(F.col("words"), 4 * F.col("at") + 1, F.lit(4)))), 16, 10)
    return word.select("blk", F.col("at").cast("long").alias("word"), value.cast("long").alias("value"))


def _flipped_back(digits):
    return F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])
