"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a pseudo-random number u in (0, 1) drawn from the md5 of the
two; a record goes to the shard with the largest ``-weight / ln(u)``. Adding a shard only
adds one more contestant, so rows move into the new shard alone, and a weight change moves
only the rows it has to. All of it is column expressions; no row meets another one except
where slots are numbered.

Defined results: a null key is the key ``""``; a null text has no bytes (size 1, crc 0);
equal keys share a shard; repeated rows keep a slot each; an empty table gives an empty
result; other columns of the input are ignored by ``shard_layout``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: md5 digits that make a draw: 48 bits are exact in a double.
DRAW_DIGITS = 12


def draw(key: Column, shard: int) -> Column:
    """u in (0, 1), from the md5 of ``key:shard``."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, DRAW_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (an index of ``weights``) that wins ``key``; ties go to the larger index."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    scores = [F.struct((F.lit(-float(w)) / F.log(draw(key, s))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard_layout(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, bucket_digits: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard for each row of ``docs``.

    ``grown_shard`` is the shard after one more of weight ``grown_weight`` has joined.
    Slots number the rows of a shard from 0 in the order of (md5 of the key, key, crc,
    size). A shard is numbered in ``16 ** bucket_digits`` pieces by the first digits of the
    md5, each in a task of its own; the pieces' sizes (at most that many rows a shard, the
    bound of what is broadcast) give each piece its first slot.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    grown = [*weights, grown_weight]
    keyed = docs.select("doc_id", key.alias("_key"), *[c for c in ["text"] if c in docs.columns]).select(
        "doc_id",
        (F.length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(F.col("_key"), weights).alias("shard"),
        rendezvous(F.col("_key"), grown).alias("grown_shard"),
        F.md5(F.col("_key").cast("binary")).alias("_order"),
    )
    piece = F.substring("_order", 1, bucket_digits).alias("_piece")
    # the counts need the key alone, so this second scan leaves the texts unread
    counted = docs.select(key.alias("_key")).select(rendezvous(F.col("_key"), weights).alias("shard"), F.substring(F.md5(F.col("_key").cast("binary")), 1, bucket_digits).alias("_piece")).groupBy("shard", "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_piece").orderBy("_order", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        keyed.withColumn("_piece", piece)
        .withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "_piece"])
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
    )
