"""The sparse product A x B and what can be known of it without expanding it.

A's column and B's row are the join key ``k``. A joined, unreduced row is a partial.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import packed
from weftline.operators.gather import RANGE, entries_of, far_rows, gather, near_rows, others
from weftline.sources.folders import cut_lineage

BLOCK = 2048
#: Partials of one key beyond which the key is cut into tiles of about as many.
TILE = 1 << 22
#: Heavy keys up to which they are broadcast (three numbers each).
SENT = 100_000
#: About the partials of a range that are only summed.
SUMMED = 4 * RANGE
#: Partials an entry from which they are summed in ranges of rows.
DENSE = 5


def _joined(a: DataFrame, b: DataFrame, *columns) -> DataFrame:
    left = a.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("a_v"))
    right = b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("b_v"))
    return left.join(right, "k").select(*columns)


def partials(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, k, j, x): one row for each pair of entries that meet, with their product."""
    return _joined(a, b, "i", "k", "j", (F.col("a_v") * F.col("b_v")).alias("x"))


def heavy_keys(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """(k, rows, columns): the keys that make more than ``tile`` partials, and how many entries of either side they have."""
    left, right = a.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("rows")), b.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("columns"))
    return left.join(right, "k").where(F.col("rows") > F.floor(F.lit(tile) / F.col("columns")))


def _tiles(a: DataFrame, b: DataFrame, heavy: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """The entries of heavy keys, each in the tiles where it meets the other side's: (i, k, a_v, down, across), (k, j, b_v, down, across)."""
    side = isqrt(tile)
    parts = heavy.select("k", F.ceil(F.col("rows") / side).alias("_down"), F.ceil(F.col("columns") / side).alias("_across"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("a_v")).join(parts, "k")
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("b_v")).join(parts, "k")
    return (
        left.select("i", "k", "a_v", F.pmod(F.xxhash64("i"), F.col("_down")).alias("down"), each("_across").alias("across")),
        right.select("k", "j", "b_v", each("_down").alias("down"), F.pmod(F.xxhash64("j"), F.col("_across")).alias("across")),
    )


def tiled_partials(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """The rows of ``partials``, with no key's in one task where they are more than ``tile``.

    A heavy key's entries are dealt by hash over the edges of a grid, and each is copied
    along the grid, so every pair meets in one tile; the copies are fewer than the partials
    by the edge of a tile. Other keys are joined as they are.
    """
    heavy = cut_lineage(heavy_keys(a, b, tile))
    n = heavy.count()
    if not n:
        return partials(a, b)
    heavy = F.broadcast(heavy) if n <= SENT else heavy
    keys = heavy.select("k")
    light = partials(a.join(keys, a["j"] == keys["k"], "left_anti"), b.join(keys, b["i"] == keys["k"], "left_anti"))
    left, right = _tiles(a, b, heavy, tile)
    return light.unionByName(left.join(right, ["k", "down", "across"]).select("i", "k", "j", (F.col("a_v") * F.col("b_v")).alias("x")))


def _counts(a: DataFrame, b: DataFrame) -> tuple[int, int, int]:
    """The partials, and the entries of A and of B that meet."""
    left, right = a.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("m")), b.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("n"))
    found = left.join(right, "k").agg(F.sum(F.col("m") * F.col("n")).alias("total"), F.sum("m").alias("m"), F.sum("n").alias("n")).first()
    return found["total"] or 0, found["m"] or 0, found["n"] or 0


def in_doubles(a: DataFrame, b: DataFrame) -> bool:
    """Whether labels and values are of the types that arrays hold."""
    return all(dict(m.dtypes)[c] == kind for m in (a, b) for c, kind in (("i", "bigint"), ("j", "bigint"), ("v", "double")))


def summed(a: DataFrame, b: DataFrame, tile: int | None = None) -> DataFrame:
    """(i, j, v, n): the product and the number of partials of each entry.

    Where partials are many times the entries, they are made and summed in ranges of rows, as wide
    as lists allow (in arrays if values are doubles), and only those of rows too long for a range
    are shuffled, with ``tile`` joined in tiles. Where they are few, dealing entries costs more than it saves, and they are dealt themselves, to as
    many tasks as they need.
    """
    total, m, n = _counts(a, b)
    sums = [F.sum("x").alias("v"), F.count("*").alias("n")]
    dealt = lambda rows: rows.select("i", "j", "x").repartition(total // RANGE + a.sparkSession.sparkContext.defaultParallelism, "i", "j").groupBy("i", "j").agg(*sums)
    if total < DENSE * (m + n):
        return dealt(partials(a, b) if tile is None else tiled_partials(a, b, tile))
    sizes = cut_lineage(row_sizes(a, b))
    far = far_rows(sizes, SUMMED)
    rows = near_rows(sizes, SUMMED)
    if in_doubles(a, b):
        near = packed.in_ranges(packed.packed(others(a, far), b, rows, packed.width(a.sparkSession, total, m, n), whole=True), packed.sums, "i long, j long, v double, n long")
    else:
        near = gather(a, b, rows, SUMMED).groupBy("r", "i", "j").agg(*sums).drop("r")
    if far.isEmpty():
        return near
    rest = entries_of(a, far)
    # long rows may have many partials an entry: summed before they are dealt, too
    joined = partials(rest, b) if tile is None else tiled_partials(rest, b, tile)
    return near.unionByName(joined.groupBy("i", "j").agg(*sums))


def product(a: DataFrame, b: DataFrame, tile: int | None = None) -> DataFrame:
    """(i, j, v): the product; sums that cancel to 0 stay. With ``tile``, keys of more partials are joined in tiles where rows are too long for a range."""
    return summed(a, b, tile).drop("n")


def pattern(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, n): the output entries and how many partials each has; values are never read."""
    one = F.lit(1.0).alias("v")
    return summed(a.select("i", "j", one), b.select("i", "j", one)).drop("v")


def symbolic_nnz(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, nnz): output entries of each row."""
    return pattern(a, b).groupBy("i").agg(F.count("*").alias("nnz"))


def row_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, row_size): partials of each row of A, from B's row lengths alone."""
    lengths = b.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("n"))
    return a.select("i", F.col("j").alias("k")).join(lengths, "k", "left").groupBy("i").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_size"))


def total_partials(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """(total, full_blocks, tail): one row, from counts by k of either side."""
    left, right = a.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("m")), b.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("n"))
    total = left.join(right, "k").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).cast("long").alias("total"))
    return total.select("total", F.floor(F.col("total") / block).cast("long").alias("full_blocks"), (F.col("total") % block).cast("long").alias("tail"))


def compression_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """(partials, nnz, ratio): how far the reduction shrinks the join."""
    out = pattern(a, b).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("partials"), F.count("*").alias("nnz"))
    return out.select("partials", "nnz", F.round(F.col("partials") / F.col("nnz"), 6).alias("ratio"))
