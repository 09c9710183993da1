"""Strided selection over sorted lists, and a heap of the last written values.

A tournament that k times takes the least next stride of any list is, as the lists are
sorted, the k first of all strides; that is a rank over the strides' ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _positions(lists: DataFrame) -> DataFrame:
    """(i, k, j, pos, len): elements of the lists with their place and the list's length."""
    w = Window.partitionBy("i", "k")
    return lists.select("i", "k", "j", (F.row_number().over(w.orderBy("j")) - 1).alias("pos"), F.count("*").over(w).alias("len"))


def _ranked(lists: DataFrame, stops, count: int, stride: int, falling: bool, start, sign: int) -> DataFrame:
    """(i, k, b): ``start`` moved by a stride for each of the list's stops among the first ``count`` of its row."""
    w = Window.partitionBy("i")
    order = [F.desc("j"), F.desc("k")] if falling else [F.col("j"), F.col("k")]
    placed = _positions(lists)
    taken = placed.where(stops).withColumn("_r", F.row_number().over(w.orderBy(*order))).where(F.col("_r") <= count).groupBy("i", "k").agg(F.count("*").alias("taken"))
    # one row a list: that of its first element
    return placed.where("pos = 0").join(taken, ["i", "k"], "left").select("i", "k", (start + sign * stride * F.coalesce("taken", F.lit(0))).cast("long").alias("b"))


def topk_advance(lists: DataFrame, count: int, stride: int) -> DataFrame:
    """From the start of each list, ``count`` times move the list whose next stride ends least."""
    return _ranked(lists, F.col("pos") % stride == stride - 1, count, stride, False, F.lit(0), 1)


def topk_retreat(lists: DataFrame, count: int, stride: int) -> DataFrame:
    """From the last whole stride of each list, ``count`` times move back the list whose last element is largest."""
    top = F.floor(F.col("len") / stride) * stride
    return _ranked(lists, (F.col("pos") % stride == stride - 1) & (F.col("pos") < top), count, stride, True, top, -1)


def topk_advance_from_right(lists: DataFrame, count: int, stride: int) -> DataFrame:
    """From the end of each list, ``count`` times move back the list whose next stride begins largest."""
    return _ranked(lists, (F.col("len") - F.col("pos")) % stride == 0, count, stride, True, F.col("len"), -1)


def topk_retreat_from_right(lists: DataFrame, count: int, stride: int) -> DataFrame:
    """From the first whole stride (seen from the right) of each list, ``count`` times move forward the list whose next element is least."""
    bottom = F.col("len") - F.floor(F.col("len") / stride) * stride
    return _ranked(lists, (F.col("pos") >= bottom) & ((F.col("pos") - bottom) % stride == 0), count, stride, False, bottom, 1)


def heap_update(writes: DataFrame) -> DataFrame:
    """(id, val): what is left after writes (id, seq, val) in the order of seq; -1 deletes."""
    last = writes.groupBy("id").agg(F.max(F.struct("seq", "val")).alias("w"))
    return last.select("id", F.col("w.val").alias("val")).where("val <> -1")


def heap_first(heap: DataFrame) -> DataFrame:
    """(id, val) of the least value, the least id of equals: one row, none of an empty heap."""
    return heap.agg(F.min(F.struct("val", "id")).alias("m")).where("m is not null").select("m.id", "m.val")
