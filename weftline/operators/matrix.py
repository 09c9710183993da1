"""Coordinate matrices: building them, CSR views, prefix sums over their rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys that one task numbers together in a prefix sum.
CHUNK_BITS = 16


def from_relation(df: DataFrame, row: str, column: str, value: str | None = None) -> DataFrame:
    """The matrix of a relation: equal coordinates are summed (without ``value``, each row counts 1)."""
    v = F.lit(1.0) if value is None else F.col(value).cast("double")
    return df.groupBy(F.col(row).cast("long").alias("i"), F.col(column).cast("long").alias("j")).agg(F.sum(v).alias("v"))


def coalesce_entries(m: DataFrame) -> DataFrame:
    """Equal coordinates summed to one entry; zeros stay."""
    return m.groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def symmetric_expand(m: DataFrame) -> DataFrame:
    """The lower triangle with its mirror image; the diagonal once."""
    return m.unionByName(transpose(m.where("i <> j")))


def row_counts(m: DataFrame) -> DataFrame:
    """(i, n): entries of each row that has any."""
    return m.groupBy("i").agg(F.count("*").alias("n"))


def key_splits(df: DataFrame, key: str, rows_each: int = 1 << CHUNK_BITS, most: int = 10_000) -> list[float]:
    """Cut points that part the keys into chunks of about ``rows_each`` rows (larger ones beyond ``most`` chunks).

    For keys that lie far apart, such as hashes; they come from one mergeable quantile sketch.
    """
    n = df.count()
    chunks = min(most, n // rows_each + 1)
    if chunks < 2:
        return []
    shares = [k / chunks for k in range(1, chunks)]
    return sorted(set(map(float, df.agg(F.percentile_approx(F.col(key).cast("double"), shares, 10 * chunks)).first()[0])))


def in_chunks(df: DataFrame, key: str, chunk_bits: int, splits: list[float] | None) -> DataFrame:
    """``df`` with ``_chunk``, the number of the chunk in which the key lies: of ``2 ** chunk_bits`` neighbouring numbers, or from one of ``splits`` to the next."""
    if splits is None:
        return df.withColumn("_chunk", F.shiftright(F.col(key).cast("long"), chunk_bits))
    if not splits:
        return df.withColumn("_chunk", F.lit(0).cast("long"))
    bucketizer = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_double", outputCol="_bucket")
    return bucketizer.transform(df.withColumn("_double", F.col(key).cast("double"))).withColumn("_chunk", F.col("_bucket").cast("long")).drop("_double", "_bucket")


def prefix_sum(df: DataFrame, key: str, value: str, out: str, within: tuple[str, ...] = (), chunk_bits: int = CHUNK_BITS, splits: list[float] | None = None, base: DataFrame | None = None, key_bits: int = 0) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over smaller keys (integers, one row each).

    Keys are summed by chunks in parallel, then the chunks' totals in order, so that no task
    orders the whole table; only the totals, one row a chunk, meet. A chunk is
    ``2 ** chunk_bits`` neighbouring numbers, or what lies between two of ``splits``. If keys have
    as many as ``key_bits`` bits, their chunks' totals are summed by chunks of chunks, so that no
    task gets more than ``2 ** chunk_bits`` rows, be the keys dense or hashes. With
    ``base`` (the columns of ``within`` and one more) the sums begin at that column's value.
    """
    return prefix_sums(df, key, {out: value}, within, chunk_bits, splits, base, key_bits)


def prefix_sums(df: DataFrame, key: str, sums: dict[str, str], within: tuple[str, ...] = (), chunk_bits: int = CHUNK_BITS, splits: list[float] | None = None, base: DataFrame | None = None, key_bits: int = 0) -> DataFrame:
    """``prefix_sum`` of several columns at once: ``sums`` has the column to sum by the name of its sum; with ``base`` all begin at its value."""
    keyed = in_chunks(df, key, chunk_bits, splits)
    totals = keyed.groupBy(*within, "_chunk").agg(*[F.sum(value).alias(f"_total_{out}") for out, value in sums.items()])
    if splits is None and 0 < 2 * chunk_bits < key_bits:
        upper = totals.withColumnRenamed("_chunk", "_key")
        offsets = prefix_sums(upper, "_key", {f"_offset_{out}": f"_total_{out}" for out in sums}, within, chunk_bits, key_bits=key_bits - chunk_bits).withColumnRenamed("_key", "_chunk")
    else:
        before = Window.partitionBy(*within).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*within, "_chunk", *[F.coalesce(F.sum(f"_total_{out}").over(before), F.lit(0)).alias(f"_offset_{out}") for out in sums])
    offsets = offsets.select(*within, "_chunk", *[f"_offset_{out}" for out in sums])
    if base is not None:
        start = [c for c in base.columns if c not in within][0]
        offsets = offsets.join(base, list(within)).select(*within, "_chunk", *[(F.col(f"_offset_{out}") + F.col(start)).alias(f"_offset_{out}") for out in sums], start)
    inside = Window.partitionBy(*within, "_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.select("*", *[F.coalesce(F.sum(value).over(inside), F.lit(0)).alias(f"_before_{out}") for out, value in sums.items()])
    joined = summed.join(offsets, [*within, "_chunk"]).withColumns({out: F.col(f"_offset_{out}") + F.col(f"_before_{out}") for out in sums})
    return joined.drop("_chunk", *[f"_{kind}_{out}" for kind in ("offset", "before") for out in sums])


def row_pointers(m: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """(i, n, ptr): where each row begins in the sorted entries.

    Over the rows that have entries, or, with a ``spine`` of all row labels (column i), over
    all of them.
    """
    counts = row_counts(m)
    if spine is not None:
        counts = spine.select(F.col("i").cast("long").alias("i")).distinct().join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return prefix_sum(counts, "i", "n", "ptr").select("i", "n", F.col("ptr").cast("long").alias("ptr"))


def sorted_positions(m: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``m`` with pos, the place of each entry in its row, from 0 or from ``base`` (i and one more column); a long row is numbered by chunks of its columns."""
    placed = prefix_sum(m.withColumn("_one", F.lit(1)), "j", "_one", "pos", within=("i",), base=base)
    return placed.select(*m.columns, F.col("pos").cast("long").alias("pos"))
