"""How the partials, ordered by (i, j, k), fall into blocks of equal size.

Nothing here expands the join: sizes of rows tell where each block ends. A block's end
that falls into a row, or on its end, cuts the row after ``p`` of its partials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.matrix import prefix_sum
from weftline.operators.product import BLOCK, row_sizes


def row_spans(a: DataFrame, b: DataFrame, label_bits: int = 32) -> DataFrame:
    """(i, row_size, row_off, row_end): where each row's partials stand among all; labels that are hashes need their ``label_bits``."""
    return spans_of(row_sizes(a, b), label_bits)


def spans_of(sizes: DataFrame, label_bits: int = 32) -> DataFrame:
    """``row_spans`` of rows (i, row_size); they are looked at twice."""
    placed = prefix_sum(sizes, "i", "row_size", "row_off", key_bits=label_bits)
    return placed.select("i", "row_size", F.col("row_off").cast("long").alias("row_off"), (F.col("row_off") + F.col("row_size")).cast("long").alias("row_end"))


def block_cuts(spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """(blk, i, p, row_size, f, reverse): the cut that ends each full block.

    ``p`` counts from the row's start. The cheaper direction to find it is from the right
    when more than half of the row lies left of it; ``f`` counts in that direction.
    """
    cut = F.explode(F.sequence(F.floor(F.col("row_off") / block), F.floor(F.col("row_end") / block) - 1)).alias("blk")
    crossed = spans.where(F.floor(F.col("row_end") / block) > F.floor(F.col("row_off") / block)).select("*", cut)
    p = ((F.col("blk") + 1) * block - F.col("row_off")).cast("long")
    reverse = (2 * F.col("p") > F.col("row_size")).cast("int")
    cuts = crossed.select(F.col("blk").cast("long").alias("blk"), "i", p.alias("p"), "row_size")
    return cuts.select("*", F.when(reverse == 1, F.col("row_size") - F.col("p")).otherwise(F.col("p")).alias("f"), reverse.alias("reverse"))


def cut_rows(a: DataFrame, cuts: DataFrame) -> DataFrame:
    """The entries of A in rows that a block's end cuts."""
    return a.join(cuts.select("i").distinct(), "i", "left_semi")


def direction_counts(cuts: DataFrame) -> DataFrame:
    return cuts.groupBy("reverse").agg(F.count("*").alias("n"))


def block_row_span(spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """(blk, start_row, end_row, nrows): the rows with partials in each block, the tail too.

    A row lists the blocks it touches, so the range join of rows and blocks is a grouping.
    """
    touched = F.explode(F.sequence(F.floor(F.col("row_off") / block), F.floor((F.col("row_end") - 1) / block))).alias("blk")
    return spans.where("row_size > 0").select("i", touched).groupBy("blk").agg(F.min("i").alias("start_row"), F.max("i").alias("end_row"), F.count("*").alias("nrows"))


def list_counts(a: DataFrame) -> DataFrame:
    """(i, m): the lists (rows of B) that row i merges."""
    return a.groupBy("i").agg(F.count("*").alias("m"))


def list_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, m, n_max, total): number of lists, the longest, and all together."""
    lengths = b.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return a.select("i", F.col("j").alias("k")).join(lengths, "k", "left").groupBy("i").agg(F.count("*").alias("m"), F.max(n).cast("long").alias("n_max"), F.sum(n).cast("long").alias("total"))


def record_openings(a: DataFrame, cuts: DataFrame) -> DataFrame:
    """(blk, i, p, m): what opens each block: the first row from its start for block 0, else the cut that ends the block before."""
    lists = list_counts(a)
    first = lists.orderBy("i").limit(1).select(F.lit(0).cast("long").alias("blk"), "i", F.lit(0).cast("long").alias("p"), "m")
    later = cuts.join(lists, "i").select((F.col("blk") + 1).alias("blk"), "i", "p", "m")
    return first.unionByName(later)


def record_offsets(openings: DataFrame) -> DataFrame:
    """(blk, ptr): the word at which each record begins; a record has three words and one a list."""
    sized = openings.select("blk", (F.col("m") + 3).alias("words"))
    return prefix_sum(sized, "blk", "words", "ptr").select("blk", F.col("ptr").cast("long").alias("ptr"))


def partition_stats(a: DataFrame, cuts: DataFrame, block: int = BLOCK, many_lists: int = 128) -> DataFrame:
    """One row of counts over all cuts.

    shorts: no more partials than lists; longs: more than half of the row to the left;
    long_rows: more than ``many_lists`` lists; singles: one list; multi_rows: rows larger
    than a block; max_cut_size: most lists; max_nrows: most rows between two cuts.
    """
    # the distance to the cut before is a self-join on the block number: no window over all cuts
    before = cuts.select((F.col("blk") + 1).alias("blk"), F.col("i").alias("last_i"))
    joined = cuts.join(list_counts(a), "i").join(before, "blk", "left")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return joined.agg(
        F.count("*").alias("splits"),
        count(F.col("p") <= F.col("m")).alias("shorts"),
        count(F.col("reverse") == 1).alias("longs"),
        count(F.col("m") > many_lists).alias("long_rows"),
        count(F.col("m") == 1).alias("singles"),
        count(F.col("row_size") > block).alias("multi_rows"),
        F.coalesce(F.max("m"), F.lit(0)).cast("long").alias("max_cut_size"),
        F.coalesce(F.max(F.col("i") - F.coalesce("last_i", F.lit(0))), F.lit(0)).cast("long").alias("max_nrows"),
    )
